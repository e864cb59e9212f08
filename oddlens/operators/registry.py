"""Names of detectors, with tags; specs as names or dicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from oddlens.operators.base import Detector

_MODELS: dict[str, tuple[type[Detector], tuple[str, ...]]] = {}


def register_model(name: str, *tags: str):
    def add(cls: type[Detector]) -> type[Detector]:
        if name in _MODELS and _MODELS[name][0] is not cls:
            raise ValueError(f"{name} is taken")
        _MODELS[name] = (cls, tags)
        return cls

    return add


def model_names(tag: str | None = None) -> list[str]:
    return sorted(n for n, (_, tags) in _MODELS.items() if tag is None or tag in tags)


def create_model(spec: str | dict | Detector, **given) -> Detector:
    """From a name, or ``{"name", "kwargs"}`` (``type`` and ``model`` also name it); keywords fill what the spec leaves open."""
    if isinstance(spec, Detector):
        return spec
    if isinstance(spec, dict):
        name = spec.get("name") or spec.get("type") or spec.get("model")
        given = {**given, **spec.get("kwargs", {})}
    else:
        name = spec
    if name not in _MODELS:
        raise KeyError(f"unknown model {name!r}; known: {', '.join(model_names())}")
    return _MODELS[name][0](**given)


def catalogue(spark: SparkSession) -> DataFrame:
    rows = [(n, cls.__name__, list(tags), {k: str(v) for k, v in cls.defaults().items()}) for n, (cls, tags) in sorted(_MODELS.items())]
    return spark.createDataFrame(rows, "name string, class string, tags array<string>, defaults map<string,string>")
