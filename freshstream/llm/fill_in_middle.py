"""Fill-in-the-middle transformation by repeated-capture matching.

``(unit)*`` is matched once against the whole text.  The ``regex`` library keeps
every repetition of a captured group, so ``match.ends(1)`` is the list of all
unit ends: its length is the number of units, its entries are the cut offsets.
Which units to cut at, and the form, come from a SHA-256 of the row's id.

No shuffle: a row is transformed where it is read.  Texts travel to Python in
slices of a few MB; a text longer than ``PIECE`` code points is matched in
pieces with the code point as unit (a piece ends where a unit ends), so the
captures held at once are bounded.

Defined results: a NULL text is the empty text and stays plain; a text with one
of the markers stays plain; so does a text that the unit pattern does not cover.
NULL ids are hashed as the empty id; repeated ids give the same cuts.  Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The unit of the contract: one code point.
CODE_POINT = r"(?s:.)"
PIECE = 1 << 20


def unit_ends(text: str, unit: str = CODE_POINT, piece: int = PIECE) -> list[list[int]] | None:
    """Ends of all units, in lists of one match each; None if the units do not
    cover the text."""
    import regex
    pattern = regex.compile(f"({unit})*")
    step = piece if unit == CODE_POINT else max(1, len(text))
    found = []
    for lo in range(0, len(text), step):
        m = pattern.fullmatch(text, lo, min(len(text), lo + step))
        if m is None:
            return None
        found.append(m.ends(1))
    return found


def end_of(found: list[list[int]], count: int) -> int:
    """Offset after ``count`` units."""
    at = 0
    for ends in found:
        if count <= len(ends):
            return ends[count - 1] if count else at
        count, at = count - len(ends), ends[-1]
    return at


def cut(text: str, h: tuple[int, int, int, int], unit: str = CODE_POINT, plain_share: int = 10,
        spm_share: int = 20) -> dict:
    """n, form, prefix, middle, suffix and the output text."""
    found = unit_ends(text, unit)
    n = sum(map(len, found)) if found is not None else 0
    marked = any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE))
    if not text or marked or found is None or h[2] % 100 >= 100 - plain_share:
        return {"n": n, "form": "plain", "prefix_chars": None, "middle_chars": None, "output": text}
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    lo, hi = end_of(found, lo), end_of(found, hi)
    prefix, middle, suffix = text[:lo], text[lo:hi], text[hi:]
    spm = h[3] % 100 < spm_share
    out = (f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}" if spm
           else f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}")
    return {"n": n, "form": "spm" if spm else "psm", "prefix_chars": lo, "middle_chars": hi - lo, "output": out}


def draws(doc_id: Column, seed: int = 1) -> list[Column]:
    """The first four 8-digit groups of the SHA-256 of ``seed:id``, as numbers."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    digest = F.sha2(name.cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1,
              unit: str = CODE_POINT, plain_share: int = 10, spm_share: int = 20) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars
    (NULL if plain) and output, the transformed text."""
    doc_id = F.col(id_col)
    inputs = docs.select(doc_id.alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                         *[h.alias(f"h{i}") for i, h in enumerate(draws(doc_id, seed))])
    schema = (f"doc_id {inputs.schema['doc_id'].dataType.simpleString()}, n bigint, form string, "
              "prefix_chars bigint, middle_chars bigint, output string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            hashes = zip(*[b.column(f"h{i}").to_pylist() for i in range(4)])
            made = [cut(t, h, unit, plain_share, spm_share) for t, h in zip(b.column("text").to_pylist(), hashes)]
            long = lambda key: pa.array([m[key] for m in made], pa.int64())
            text = lambda key: pa.array([m[key] for m in made], pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), long("n"), text("form"), long("prefix_chars"), long("middle_chars"),
                 text("output")], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return inputs.mapInArrow(run, schema)


def restore(form: Column, output: Column) -> Column:
    """The text that ``output`` was made of.  Transformed texts hold no marker
    of their own, so each marker occurs once."""
    first = F.substring_index(output, MIDDLE, 1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(F.substring_index(first, SUFFIX, 1).substr(F.lit(len(PREFIX) + 1), F.length(output)), middle,
                   F.substring_index(first, SUFFIX, -1))
    spm = F.concat(F.substring_index(first, PREFIX, -1), middle,
                   F.substring_index(first, PREFIX, 1).substr(F.lit(len(SUFFIX) + 1), F.length(output)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
