"""Token counting behind one interface, and budgets."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TokenCounter = Callable[[str], int]

_PIECES = re.compile(r"\w{1,4}|[^\w\s]|\s+")

MIN_BUDGET, MAX_BUDGET = 256, 64_000


def count_pieces(text: str) -> int:
    """A deterministic stand-in for a model's tokenizer; it is no model's own count."""
    return sum(1 for x in _PIECES.findall(text) if x.strip() or "\n" in x)


def piece_count(text: Column) -> Column:
    """An additive cost for relational packing: four characters a token, one at least."""
    return F.greatest(F.ceil(F.length(text) / F.lit(4.0)), F.lit(1)).cast("long")


def bpe_counter(path: str) -> TokenCounter:
    """Counts with a tokenizer file, where one is at hand."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def checked_budget(budget: int) -> int:
    if isinstance(budget, bool) or not isinstance(budget, int) or not MIN_BUDGET <= budget <= MAX_BUDGET:
        raise ValueError(f"a token budget is a whole number from {MIN_BUDGET} to {MAX_BUDGET}")
    return budget
