"""Request parameters checked before any job runs."""

from __future__ import annotations

from canonspark.functions.similarity import check_scorer
from canonspark.functions.text import FALSE_TOKENS, TRUE_TOKENS

_BOOLEANS = dict.fromkeys(TRUE_TOKENS, True) | dict.fromkeys(FALSE_TOKENS, False)


def parse_bool(value) -> bool:
    """N12 for parameters, the same tokens as ``functions.text.to_bool`` (used for
    ``ml_mode`` in both modes, D3)."""
    token = str(value).strip().lower()
    try:
        return _BOOLEANS[token]
    except KeyError:
        raise ValueError(f"{value!r} is neither of {', '.join(_BOOLEANS)}") from None


def parse_threshold(value) -> float:
    """A threshold given as text is a whole number."""
    return int(value) if isinstance(value, str) else value


def check_request(columns, match_mode: str = "ratio", threshold=75, ml_mode=False):
    """Validate a grouping request; returns (columns, scorer, threshold, ml)."""
    if not isinstance(columns, (list, tuple)) or not columns:
        raise ValueError("name at least one column to clean, as a list")
    check_scorer(match_mode)
    return list(columns), match_mode, parse_threshold(threshold), parse_bool(ml_mode)
