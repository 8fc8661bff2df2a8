import hashlib

from tallyloom.sources.collectors import LEAST_PICTURE, collect_effects


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_ten_kinds_in_one_scan(spark, tmp_path):
    big, small = b"p" * LEAST_PICTURE, b"q"
    whole = {
        "run_state.json": b'{"x": 1, "s": "[1, 2]", "t": "plain", "n": null}', "run_uncapturable.json": b'["f", "g"]', "run_env.json": b'{"A": "1", "B": [2]}', "run_html.json": b'{"b": "<p>2</p>", "a": "<p>1</p>"}',
        "run_network.json": b'[["GET", "http://x", "h"], "odd"]', "run_rng.json": b'[["rnorm", [1], 0.5]]', "run_warnings.json": '["w é", "v"]'.encode(), "run_plot_2.png": big + b"2", "run_plot_1.png": big, "run_plot_3.png": small,
        "stdout.txt": b'> source("a.R", print.eval = TRUE)\n\n\nout \xff\n', "stderr.txt": "é".encode(), "out/new.csv": b"a,b", "same.txt": b"same", "changed.txt": b"new", "run_tempfiles/deep/t.txt": b"t", "run_script.py": b"x",
    }
    broken = {"run_state.json": b"{broken", "run_env.json": b"[1]", "run_html.json": b"<", "run_network.json": b"{}", "run_rng.json": b"null", "run_warnings.json": b"\xff\xfe", "run_uncapturable.json": b'"text"'}
    for run, files in (("one", whole), ("two", broken), ("three", {"only.txt": b"x"})):
        for name, content in files.items():
            (tmp_path / run / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / run / name).write_bytes(content)
    before = spark.createDataFrame([("one", "same.txt", sha(b"same")), ("one", "changed.txt", sha(b"old")), ("two", "same.txt", sha(b"same"))], "run string, path string, hash string")
    got = {r.run: r for r in collect_effects(spark, str(tmp_path), before).collect()}
    assert set(got) == {"one", "two", "three"}
    r = got["one"]
    assert r.data == {"x": "1", "s": "[1,2]", "t": '"plain"', "n": "null"} and r.uncapturable == ["f", "g"] and r.env == {"A": "1", "B": "[2]"} and r.html == ["<p>1</p>", "<p>2</p>"]
    assert r.network == ['["GET","http://x","h"]'] and r.rng == ['["rnorm",[1],0.5]'] and r.warnings == ["w é", "v"] and r.problems == []
    assert [(g.name, g.size, g.sha256) for g in r.graphics] == [("run_plot_1.png", LEAST_PICTURE, sha(big)), ("run_plot_2.png", LEAST_PICTURE + 1, sha(big + b"2"))]
    assert r.stdout == "out �\n" and r.stderr == "é"
    assert r.files == {"out/new.csv": sha(b"a,b"), "changed.txt": sha(b"new"), "tempfile:t.txt": sha(b"t")}
    r = got["two"]
    empty = [r.data, r.env, r.files, r.uncapturable, r.html, r.network, r.rng, r.warnings, r.graphics]
    assert not any(empty) and (r.stdout, r.stderr) == ("", "")
    assert {(p.file, p.reason) for p in r.problems} == {
        ("run_state.json", "corrupt"), ("run_env.json", "no object"), ("run_html.json", "corrupt"), ("run_network.json", "no array"), ("run_rng.json", "no array"), ("run_warnings.json", "corrupt"), ("run_uncapturable.json", "no array")}
    assert got["three"].files == {"only.txt": sha(b"x")} and got["three"].problems == []
    assert collect_effects(spark, str(tmp_path)).where("run = 'one'").first().files.keys() >= {"same.txt", "changed.txt"}
