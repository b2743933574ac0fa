"""Request parameters of windows and of co-occurrences, as options of the operators. What can't be read is passed over, so that defaults hold."""

from __future__ import annotations

from collections.abc import Callable, Mapping

MAX_WINDOWS = 10_000
SORT_ORDERS = ("PRE", "POST", "TARGET_PRE", "TARGET_POST", "DOC", "NONE")


def _given(parameters: Mapping[str, str], names: Mapping[str, tuple[str, Callable[[str], object]]], prefix: str) -> dict:
    out = {}
    for name, (option, read) in names.items():
        value = parameters.get(prefix + name, parameters.get(name))
        try:
            if value is not None:
                out[option] = read(value)
        except ValueError:
            pass
    return out


def _size(text: str) -> int:
    if (n := int(text)) < 0:
        raise ValueError(text)
    return n


def _windows(text: str) -> int | None:
    """A limit; a negative one is none."""
    return None if (n := int(text)) < 0 else n


def _flag(text: str) -> bool:
    if text.lower() not in ("true", "false"):
        raise ValueError(text)
    return text.lower() == "true"


def _order(text: str) -> str:
    if text.upper() not in SORT_ORDERS:
        raise ValueError(text)
    return text.upper()


def _names(text: str) -> list[str]:
    return [x for x in text.replace(",", " ").split() if x]


_BOTH = {"tokensBefore": ("before", _size), "tokensAfter": ("after", _size), "maxWindows": ("limit", _windows)}


def kwic_options(parameters: Mapping[str, str], prefix: str = "") -> dict:
    """For kwic.windows: tokensBefore, tokensAfter, maxWindows (10,000 unless said otherwise), targetOverlaps, sortOrder and fl (metadata), with a prefix or without."""
    names = _BOTH | {"targetOverlaps": ("overlaps", _flag), "sortOrder": ("order", _order), "fl": ("metadata", _names)}
    return {"limit": MAX_WINDOWS} | _given(parameters, names, prefix)


def cooccur_options(parameters: Mapping[str, str], prefix: str = "") -> dict:
    """For stats.cooccurrences: those of windows, minNGram, maxNGram, minTF and numResults."""
    names = _BOTH | {"minNGram": ("low", _size), "maxNGram": ("high", _size), "minTF": ("min_tf", _size), "numResults": ("n", _size)}
    return {"limit": MAX_WINDOWS} | _given(parameters, names, prefix)


def filters(parameters: Mapping[str, str | list[str]]) -> list[str]:
    """The filter queries fq, of which there may be many; each has to match (see search.all_of)."""
    value = parameters.get("fq", [])
    return [value] if isinstance(value, str) else list(value)
