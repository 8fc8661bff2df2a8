import collections

import numpy as np
from test_llm_operators import texts

from tallyloom.llm import textnum, token_shards


def test_shards_of_very_long_texts(spark):
    """A text over CHUNK bytes and one over a shard's records; each record is found once, whole."""
    rows = [(1, "alpha beta " * 60_000, "a"), (2, "gamma " * 3000, "a"), (3, None, "a"), (4, "z" * 20_000, "b")]
    assert len(rows[0][1]) > textnum.CHUNK
    layout = token_shards.Layout(length=64, per_shard=200, waves=2)
    path, manifest = token_shards.write_shards(texts(spark, rows), layout=layout)
    records = {r.slot: np.frombuffer(r.record, "<u2") for r in token_shards.read_shards(spark, path, layout).collect()}
    encoding = token_shards.encoding(token_shards.byte_bpe_path())
    want = collections.Counter()
    for i, t, _ in rows:
        ids = [*encoding.encode_ordinary(t or ""), token_shards.END]
        want.update((i, s, tuple(ids[s * 64 : s * 64 + 64])) for s in range(-(-len(ids) // 64)))
    assert collections.Counter((r["_id"], r.seq, tuple(records[r.slot][: r.n_tokens].tolist())) for r in manifest.collect()) == want
    assert sorted(records) == list(range(sum(want.values())))
