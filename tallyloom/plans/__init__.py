"""Named queries; importing the package registers them all."""

from . import catalog, code, effects, experiments, knowledge, values, verbs

__all__ = ["catalog", "code", "effects", "experiments", "knowledge", "values", "verbs"]
