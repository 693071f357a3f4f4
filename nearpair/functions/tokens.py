"""Tokenizers as column expressions (string column -> array column)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that pad a text before and after for q-grams.
PAD_LEFT, PAD_RIGHT = "#", "$"

TOKENIZERS = ("space", "qgram", "char")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, with the value computed once: a lambda's body evaluates plain expressions anew
    for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def space_tokens(text: Column) -> Column:
    """Tokens between single spaces, repeats kept, empty ones dropped."""
    return F.array_remove(F.split(text, " "), "")


def packed_tokens(tokens: str) -> Column:
    """An array of tokens as one text, half as large where it is shuffled. Split at spaces it has as many
    tokens; those with a space or the mark in them are written with marks, so different ones stay different."""
    return F.array_join(F.transform(tokens, lambda t: F.replace(F.replace(t, F.lit("\x01"), F.lit("\x01a")), F.lit(" "), F.lit("\x01b"))), " ")


def padded(text: Column, q: int) -> Column:
    return F.concat(F.lit(PAD_LEFT * (q - 1)), text, F.lit(PAD_RIGHT * (q - 1)))


def qgrams(text: Column, q: int) -> Column:
    """All q-grams of the padded text, in text order; element i starts at position i.

    Put together from the text's characters: taking substrings of a long text would walk over it
    for every gram.
    """
    check_q(q)
    count = F.length(text) + (q - 1)

    def grams(chars: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), count - 1), lambda i: F.concat(*[F.get(chars, i + k) for k in range(q)])
        )

    # sequence(0, -1) counts down, so the one empty case (q = 1, empty text) is split off
    return F.when(count >= 1, bound(F.split(padded(text, q), ""), grams)).when(
        count < 1, F.array().cast("array<string>")
    )


def qgram_count(text: Column, q: int) -> Column:
    """Number of padded q-grams, without building them."""
    return F.length(text) + (q - 1)


def char_tokens(text: Column) -> Column:
    """The distinct characters of a text."""
    return F.array_distinct(F.array_remove(F.split(text, ""), ""))


def tokenize(text: Column, tokenizer: str, q: int = 3) -> Column:
    """Token array of `text` under a named tokenizer; null for null text."""
    if tokenizer == "space":
        return space_tokens(text)
    if tokenizer == "qgram":
        return qgrams(text, q)
    if tokenizer == "char":
        return char_tokens(text)
    raise ValueError(f"tokenizer must be one of {TOKENIZERS}, got {tokenizer!r}")


def check_q(q: int) -> None:
    if not isinstance(q, int) or q < 1:
        raise ValueError(f"q must be a positive integer, got {q!r}")


def counted_tokens(tokens: Column) -> Column:
    """Bag as a set: the k-th copy of a token becomes token + k.

    Set functions then count multiplicity. Only for tokens of one fixed length (q-grams),
    where the appended number cannot be confused with the token. Runs of the sorted bag are
    numbered one after the other, in time linear in the bag (but for the sort).
    """

    def runs(ordered: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(ordered))  # the last one lies behind the bag
        new = F.filter(places, lambda i: (i == 0) | (i == F.size(ordered)) | (F.get(ordered, i) != F.get(ordered, i - 1)))

        def numbered(starts: Column) -> Column:
            def run(start: Column, k: Column) -> Column:
                token = F.get(ordered, start)
                copies = F.sequence(F.lit(1), F.get(starts, k + 1) - start)
                return F.transform(copies, lambda c: F.concat(token, c.cast("string")))

            return F.flatten(F.transform(F.slice(starts, F.lit(1), F.size(starts) - 1), run))

        return F.when(F.size(ordered) > 0, bound(new, numbered)).when(F.size(ordered) == 0, ordered)

    return bound(F.sort_array(tokens), runs)


def deletion_keys(text: Column, tau: int) -> Column:
    """Hashes of all strings left after deleting at most `tau` characters from `text`.

    Two texts within edit distance tau always have one of these in common, and a variant
    belongs to a bounded number of texts (those at most tau insertions away from it).
    """

    def shorter(state: Column) -> Column:
        rest, start = state["rest"], state["start"]
        # deleting from left to right reaches each choice of positions once
        return F.when(
            start <= F.length(rest),
            F.transform(
                F.sequence(start, F.length(rest)),
                lambda i: F.struct(
                    F.concat(
                        F.substring(rest, F.lit(1), i - 1), F.substring(rest, i + 1, F.length(rest))
                    ).alias("rest"),
                    i.alias("start"),
                ),
            ),
        )

    level = F.array(F.struct(text.alias("rest"), F.lit(1).alias("start")))
    levels = [level]
    for _ in range(tau):
        lists = F.filter(F.transform(level, shorter), lambda found: found.isNotNull())
        level = F.flatten(lists)
        levels.append(level)
    return F.array_distinct(
        F.transform(F.concat(*levels), lambda state: F.xxhash64(state["rest"]))
    )
