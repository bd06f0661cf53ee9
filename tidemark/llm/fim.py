"""Operator 13: fill-in-middle: texts cut at two lines, put in another order between sentinels, and put back."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The marks before the prefix, the suffix and the middle.
MARKS = (b"<P>", b"<S>", b"<M>")
#: A checkpoint is kept for so many units, and texts are scanned so many bytes at a time.
EVERY, SCANNED = 64, 1 << 16
SHAPED = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


class LineIndex:
    """Units of a text (lines with their line feed, and the rest after the last one) by a sparse index of checkpoints.

    Counting scans the text once and keeps the byte and code-point offset of every `every`-th unit's start. The offsets
    of any other unit are found from the last checkpoint before it, so the index is small whatever the text's length.
    """

    def __init__(self, data: bytes, every: int = EVERY, scanned: int = SCANNED):
        self.data, self.every = data, every
        self.bytes, self.points = [0], [0]
        self.n, points = 0, 0
        for start in range(0, len(data), scanned):
            block = np.frombuffer(data, np.uint8, min(scanned, len(data) - start), start)
            ends = np.flatnonzero(block == 10) + 1
            leads = (block & 0xC0) != 0x80
            # The units that start after these line feeds are number self.n + 1 and on.
            kept = ends[(-(self.n + 1)) % every :: every]
            if len(kept):
                upto = np.cumsum(leads)[kept - 1]
                self.bytes += (start + kept).tolist()
                self.points += (points + upto).tolist()
            self.n += len(ends)
            points += int(np.count_nonzero(leads))
        if data and not data.endswith(b"\n"):
            self.n += 1
        self.end = (len(data), points)

    def cut(self, unit: int) -> tuple[int, int]:
        """(byte offset, code-point offset) at which the first `unit` units end."""
        if unit >= self.n:
            return self.end
        at = bisect_right(range(0, len(self.bytes) * self.every, self.every), unit) - 1
        start = place = self.bytes[at]
        for _ in range(unit - at * self.every):
            place = self.data.index(b"\n", place) + 1
        return place, self.points[at] + len(self.data[start:place].decode())


@dataclass(frozen=True)
class Plan:
    """How documents are shaped: the seed of their draws, and of 100 how many are shaped at all and how many of these are spm."""

    seed: int = 7
    shaped: int = 100
    spm: int = 50

    def draws(self, doc_id: int | None) -> list[int]:
        """The four draws of a document; rows without doc_id share those of the empty id."""
        digest = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


@dataclass(frozen=True)
class Shaped:
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: bytes


def shape(data: bytes, doc_id: int | None, plan: Plan) -> Shaped:
    index = LineIndex(data)
    h1, h2, h3, h4 = plan.draws(doc_id)
    if not data or any(m in data for m in MARKS) or h3 % 100 >= plan.shaped:
        return Shaped(index.n, "plain", None, None, data)
    (a, a_points), (b, b_points) = map(index.cut, sorted((h1 % (index.n + 1), h2 % (index.n + 1))))
    p, s, m = MARKS
    if h4 % 100 < plan.spm:
        form, output = "spm", b"".join((s, data[b:], p, data[:a], m, data[a:b]))
    else:
        form, output = "psm", b"".join((p, data[:a], s, data[b:], m, data[a:b]))
    return Shaped(index.n, form, a_points, b_points - a_points, output)


def restore(output: bytes, form: str) -> bytes:
    """The text of an output. No mark can begin in a piece and end in a mark, so the first ones found are the marks."""
    if form == "plain":
        return output
    first, second = (b"<S>", b"<P>") if form == "spm" else (b"<P>", b"<S>")
    if not output.startswith(first):
        raise ValueError(f"no {form} output")
    at = output.index(second, 3)
    end = output.index(b"<M>", at + 3)
    one, two, middle = output[3:at], output[at + 3 : end], output[end + 3 :]
    return two + middle + one if form == "spm" else one + middle + two


def _shaping(plan: Plan, held: int = 16_000_000) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        names = [c.split()[0] for c in SHAPED.split(", ")]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*[r[:5] for r in rows], strict=True), kinds, strict=False)]
            texts = pa.array([r[5] for r in rows], pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([*columns, texts], names)

        for batch in batches:
            rows, size = [], 0
            texts = batch.column("text").cast(pa.binary() if pa.types.is_string(batch.column("text").type) else pa.large_binary())
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                x = shape(text.as_py() or b"", doc_id, plan)
                rows.append((doc_id, x.n, x.form, x.prefix_chars, x.middle_chars, x.output))
                size += len(x.output)
                if size > held:
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)

    return run


def fill_in_middle(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:  # noqa: B008
    """SHAPED for each row of docs (doc_id, text; other columns are not read): its text cut at two units and shaped.

    n is the number of units. A null text counts as empty, and an empty text, one that holds a mark, and one that the plan
    leaves alone is plain: its output is the text, and there are no prefix_chars and middle_chars. Cuts may fall together
    or at the ends, which leaves pieces empty. Rows that repeat a doc_id are shaped by the same draws, those without one
    by the draws of the empty id. Rows stay where they are: nothing is shuffled. An empty table gives no rows.
    """
    return docs.select("doc_id", "text").mapInArrow(_shaping(plan), SHAPED)


def _restoring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "text"]
    for batch in batches:
        own = [batch.column(c) for c in names[:-1]]
        outputs = own[-1].cast(pa.binary() if pa.types.is_string(own[-1].type) else pa.large_binary())
        texts = pa.array([restore(x.as_py(), form) for x, form in zip(outputs, own[2].to_pylist(), strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([*own, texts.cast(pa.string())], names)


def restored(shaped: DataFrame) -> DataFrame:
    """SHAPED with `text`, built from output and form alone."""
    return shaped.select(*[c.split()[0] for c in SHAPED.split(", ")]).mapInArrow(_restoring, f"{SHAPED}, text string")


#: The query op13_fill_in_middle in DuckDB SQL.
FIM_SQL = r"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
l AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM h),
f AS (
  SELECT *, len(units) AS n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
    least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b FROM l),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""
