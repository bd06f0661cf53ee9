"""Operators 5 and 7: token ids in ORC files, and token counts without ids.

Both read a public tokenizer file by its path and use that file's own library. A text is cut at a place that no token
spans, before white space that follows a character other than white space, so what each distinct piece of text gives is
found once and looked up after that. Where the file's pattern ends a token between a letter and a mark, a text is cut there
too, so a word is one piece whatever mark follows it. The look-up tables of a worker are bounded.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held_by_worker, partitions, runs, shared_folder

#: Characters that are white space to Python but not to the tokenizers' patterns, or the other way round.
ODD = re.compile("[\x1c-\x1f\x85\u180e]")
ODD_ASCII = "\x1c\x1d\x1e\x1f"
#: White space and the characters after it up to the next white space; the last piece may be white space only.
PIECE = re.compile(r"\s*\S+|\s+\Z")
#: White space in other forms than single spaces and line feeds between other characters, and zero characters.
UNEVEN = "  |\n\n| \n|\n |[\\x00\t\r\x0b\x0c\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Before a piece that no space or line feed starts; texts that hold it are cut by the pattern.
HEAD = "\0"
LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]"
#: A letter and a mark: ByteLevel's pattern always ends a pre-token between them.
MARKED = f"({LETTERS})([.,;:!?*#%$])"
#: What operator 7's look-up table of a worker holds at most, and how many characters of text are encoded in one go.
MOST_KEPT = 800_000
TEXT_AT_ONCE = 2_000_000


def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def odd(text: str) -> bool:
    """Whether a text has white space characters that Python and the tokenizers' patterns may not agree on."""
    if text.isascii():
        return any(c in text for c in ODD_ASCII)
    return ODD.search(text) is not None


class IdEncoder:
    """Ids of whole texts as bytes of little-endian unsigned 32-bit integers."""

    most_kept = 400_000

    def __init__(self, path: str):
        self.tokenizer, self.known = _tokenizer(path), {}
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        step = self.tokenizer.pre_tokenizer
        # The byte alphabet: printable characters of Latin-1 stand for themselves, other bytes for characters from U+0100 on.
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in printable)}
        self.alphabet = np.array([others.get(b, b) for b in range(256)], "<u2")
        # A piece of letters holds no special string, nor does a cut between a letter and a mark fall into one.
        self.simple = self.tokenizer.normalizer is None and type(step).__name__ == "ByteLevel" and step.use_regex and not step.add_prefix_space and all("<" in x for x in special)
        self.apart = self.simple and not any(re.search(rf"\s|{MARKED}", x) for x in special)

    def _whole(self, text: str) -> bytes:
        return self._wholes([text])[0]

    def _wholes(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of pre-tokens, given to the model in the byte alphabet, into which they are put in one go."""
        own = self.alphabet[np.frombuffer("\0".join(words).encode(), np.uint8)].tobytes().decode("utf-16-le")
        tokenize = self.tokenizer.model.tokenize
        return [array("I", [x.id for x in tokenize(x)]).tobytes() for x in own.split(chr(self.alphabet[0]))]

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces. Letters of Latin-1 after a blank or none are one pre-token; others go to the library as they are."""
        simple = [self.simple and (y := x[1:] if x[:1] == " " else x).isalpha() and (y.isascii() or max(y) <= "\xff") for x in pieces]
        words, others = ([x for x, own in zip(pieces, simple, strict=True) if own is kind] for kind in (True, False))
        words, others = iter(self._words(words) if words else []), iter(self._wholes(others))
        return [next(words if own else others) for own in simple]

    def _cut(self, texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray, list[int]]:
        """(keys of all pieces, where each text's begin, order of the texts): texts of single spaces and line feeds first.

        These are split at spaces by Arrow, any other text by a pattern. A key with HEAD stands for the piece after it, a
        key with a line feed for itself, and any other one for a space and itself.
        """
        uneven = pc.match_substring_regex(pa.array(texts, pa.large_string()), UNEVEN).to_numpy(zero_copy_only=False).astype(bool)
        order = np.argsort(uneven, kind="stable").tolist()
        n_even = len(texts) - int(uneven.sum())
        plain = pa.array([HEAD + texts[i] for i in order[:n_even]], pa.large_string())
        plain = pc.replace_substring(plain, "\n", f" \n {HEAD}" if self.apart else " \n")
        if self.apart:
            plain = pc.replace_substring_regex(plain, MARKED, f"\\1 {HEAD}\\2")
        split = pc.split_pattern(plain, " ")
        other = [[HEAD + x for x in PIECE.findall(texts[i])] for i in order[n_even:]]
        keys = pa.concat_arrays([split.flatten(), pa.array([x for some in other for x in some], pa.large_string())]).dictionary_encode()
        n = np.concatenate([pc.list_value_length(split).to_numpy(zero_copy_only=False), [len(x) for x in other]])
        return keys, np.concatenate([[0], np.cumsum(n)]).astype(np.int64), order

    def _learned(self, texts: list[str]) -> tuple[list, np.ndarray, np.ndarray, list[int]]:
        """(what is kept of each distinct key, the key of each piece, where each text's pieces begin, order of the texts)."""
        keys, starts, order = self._cut(texts)
        distinct, known = keys.dictionary.to_numpy(zero_copy_only=False).tolist(), self.known
        kept = list(map(known.get, distinct))
        missed = [i for i, x in enumerate(kept) if x is None]
        new = [distinct[i] for i in missed]
        found = self._kept([x[1:] if x[:1] == HEAD else x if x[:1] == "\n" else " " + x for x in new])
        for i, x in zip(missed, found, strict=True):
            kept[i] = x
        # What doesn't fit is found again in later calls: by then the frequent pieces are known.
        known.update(islice(zip(new, found, strict=True), max(0, self.most_kept - len(known))))
        return kept, keys.indices.to_numpy(), starts, order

    def _kept(self, pieces: list[str]) -> list:
        """What the look-up tables keep of pieces."""
        return self._ids(pieces)

    def _odd(self, texts: list[str]) -> list[int]:
        return np.flatnonzero(pc.match_substring_regex(pa.array(texts, pa.large_string()), ODD.pattern).to_numpy(zero_copy_only=False)).tolist()

    def encode(self, texts: list[str]) -> list[bytes]:
        out = {i: self._whole(texts[i]) for i in self._odd(texts)}
        rest = [i for i in range(len(texts)) if i not in out]
        if rest:
            ids, which, starts, order = self._learned([texts[i] for i in rest])
            joined = pa.array(ids, pa.large_binary()).take(pa.array(which))
            ends, data = np.frombuffer(joined.buffers()[1], np.int64)[starts], memoryview(joined.buffers()[2] or b"")
            out |= {rest[i]: bytes(data[a:z]) for i, a, z in zip(order, ends[:-1].tolist(), ends[1:].tolist(), strict=True)}
        return [out[i] for i in range(len(texts))]


class TokenCounter(IdEncoder):
    """Numbers of ids of whole texts; the look-up tables keep numbers in place of ids, and fewer."""

    most_kept = 400_000

    def _kept(self, pieces: list[str]) -> list[int]:
        return [len(x) // 4 for x in self._ids(pieces)]

    def count(self, texts: list[str]) -> list[int]:
        out = {i: len(self._whole(texts[i])) // 4 for i in self._odd(texts)}
        rest = [i for i in range(len(texts)) if i not in out]
        if rest:
            n, which, starts, order = self._learned([texts[i] for i in rest])
            before = np.concatenate([[0], np.cumsum(np.asarray(n, np.int64)[which])])[starts]
            out |= {rest[i]: k for i, k in zip(order, np.diff(before).tolist(), strict=True)}
        return [out[i] for i in range(len(texts))]


def id_encoder(path: str) -> IdEncoder:
    return held_by_worker(("ids", path), lambda: IdEncoder(path))


def token_counter(path: str) -> TokenCounter:
    return held_by_worker(("counts", path), lambda: TokenCounter(path))


def _measuring(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(path)
        for batch in batches:
            texts, n, held = [], [], 0
            for text in batch.column("text"):
                texts.append(text.as_py() or "")
                held += len(texts[-1])
                if held > TEXT_AT_ONCE:
                    n += counter.count(texts)
                    texts, held = [], 0
            if texts:
                n += counter.count(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return run


def token_lengths(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row (doc_id, n_tokens) for each row of docs: the number of tokens of its whole text, without an end mark.

    Rows stay where they are, so nothing is shuffled or joined. A null text counts as empty; only doc_id and text are read.
    """
    return docs.select("doc_id", "text").mapInArrow(_measuring(tokenizer_path), "doc_id bigint, n_tokens bigint")


ENCODED = "part int, doc_id bigint, local_start bigint, n_tokens bigint, ids array<int>"


def _encoding(path: str, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, start, encoder = TaskContext.get().partitionId(), 0, id_encoder(path)
        end = np.asarray([end_id], "<u4").tobytes()

        def made(doc_ids: list, ids: list[bytes]) -> pa.RecordBatch:
            nonlocal start
            n = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            columns = [pa.array(np.full(len(n), part, np.int32)), pa.array(doc_ids, pa.int64()), pa.array(start + offsets[:-1].astype(np.int64)), pa.array(n), pa.ListArray.from_arrays(pa.array(offsets), values)]
            start += int(offsets[-1])
            return pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "local_start", "n_tokens", "ids"])

        for batch in batches:
            doc_ids, texts, held = [], [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                texts.append(text.as_py() or "")
                doc_ids.append(doc_id)
                held += len(texts[-1])
                if held > TEXT_AT_ONCE:
                    yield made(doc_ids, [x + end for x in encoder.encode(texts)])
                    doc_ids, texts, held = [], [], 0
            if texts:
                yield made(doc_ids, [x + end for x in encoder.encode(texts)])

    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 2, files: int | None = None) -> None:
    """Writes the ids of every whole text, each document's followed by end_id, as ORC files in ascending doc_id order.

    One row is a document: part, doc_id, local_start (ids before it in its part), n_tokens and ids. ORC keeps the ids as
    run-length encoded integers with row indexes in every stripe and Bloom filters on doc_id, so a reader can take
    stripes in parallel and skip those without a document that it looks for. Documents are dealt to parts by doc_id
    range, null first. Rows that repeat a doc_id, or have none, follow each other in the order of their texts' first 64
    characters, then of their hashes and row numbers, by which they spread over parts as others do. A null text counts as
    empty. Only doc_id and text are read; other columns may have any names. An empty table gives no rows.
    """
    keys = [F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 64), F.xxhash64("text"), "row"]
    told = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    ordered = told.repartitionByRange(files or partitions(docs.sparkSession), *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    rows = ordered.mapInArrow(_encoding(tokenizer_path, end_id), ENCODED)
    options = {"compression": "zstd", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}
    rows.write.format("orc").options(**options).save(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files' rows (doc_id, start, n_tokens, ids); start is the number of ids of all documents before it.

    The parts' totals, one row for each part, are summed in order and joined; the part count is fixed by the writer.
    """
    rows = spark.read.schema(ENCODED).orc(folder)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("part").agg(F.sum("n_tokens").alias("total")).select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        values, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
        crc = [zlib.crc32(values[a:z].tobytes()) for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_file_checksums(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what read_token_files returns."""
    return rows.mapInArrow(_checksums, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_folder(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_folder(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


class PreTokens:
    """Pre-tokens of pieces of text, as numbers; `number` has the number of each pre-token."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(f"({'|'.join(sorted(special, key=len, reverse=True))})") if special else None
        plain = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # A text without any of these characters has no special string; one with white space inside could span pieces.
        self.leads, self.spanning = {x[0] for x in plain}, any(x.split() != [x] for x in plain)
        self.clear()

    def clear(self) -> None:
        self.number, self.pieces, self.first, self.flat = {}, {}, [0], []

    def _split(self, text: str) -> list[str]:
        t = self.tokenizer
        parts = self.special.split(text) if any(c in text for c in self.leads) else [text]
        out = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(part)  # a special string is one token
            elif part:
                part = t.normalizer.normalize_str(part) if t.normalizer else part
                out += [x for x, _ in t.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def _learn(self, pieces: list[str], split: list[list[str]]) -> None:
        for piece, words in zip(pieces, split, strict=True):
            self.flat += [self.number.setdefault(x, len(self.number)) for x in words]
            self.first.append(len(self.flat))
            self.pieces[piece] = len(self.pieces)

    def add(self, pieces: list[str]) -> None:
        """Learns pieces without white space inside; those without special strings go through the library in one call."""
        odd = [x for x in pieces if self.special and self.special.search(x)]
        self._learn(odd, [self._split(x) for x in odd])
        plain = [x for x in pieces if x not in self.pieces]
        if not plain:
            return
        t, text = self.tokenizer, " ".join(plain)
        text = t.normalizer.normalize_str(text) if t.normalizer else text
        gaps = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 32)
        if len(gaps) != len(plain) - 1:
            return self._learn(plain, [self._split(x) for x in plain])
        found = t.pre_tokenizer.pre_tokenize_str(text)
        owner = np.searchsorted(gaps, np.fromiter((a for _, (a, _) in found), np.int64, len(found)))
        number = self.number
        start = len(self.flat)
        self.flat += [number.setdefault(x, len(number)) for x, _ in found]
        self.first += (start + np.cumsum(np.bincount(owner, minlength=len(plain)))).tolist()
        self.pieces.update(zip(plain, range(len(self.pieces), len(self.pieces) + len(plain)), strict=True))

    def numbers(self, text: str) -> np.ndarray:
        """Numbers of the pieces of a whole text."""
        if self.spanning or odd(text):
            if text not in self.pieces:
                self._learn([text], [self._split(text)])
            return np.asarray([self.pieces[text]])
        pieces, known = text.split(), self.pieces
        if new := set(pieces).difference(known):
            self.add(list(new))
        return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))


POSTED = "part int, block bigint, words string, starts binary, postings binary, doc_ids array<bigint>, n_bytes array<bigint>"
FIELDS = ["part", "block", "words", "starts", "postings", "doc_ids", "n_bytes"]
POSTING = np.dtype([("doc", "<u2"), ("n", "<u2")])
PARTIAL = np.dtype([("doc", "<u2"), ("n", "<u4")])
MOST_DOCS, MOST_TEXT = 60_000, 12_000_000
LISTED = pa.list_(pa.int64())


def _posted(pre: PreTokens, found: list[np.ndarray], parts: int) -> Iterator[tuple[int, str, bytes, bytes]]:
    """A block's postings by part of its pre-tokens: the part, its pre-tokens, where their postings start, postings."""
    names = list(pre.number)
    part = np.fromiter((zlib.crc32(x.encode()) % parts for x in names), np.int64, len(names))
    order = np.argsort(part, kind="stable")
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    pieces = np.concatenate(found)
    first, flat = np.asarray(pre.first), rank[np.asarray(pre.flat, np.int64)]
    n = first[pieces + 1] - first[pieces]
    at = np.repeat(first[pieces] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    doc = np.repeat(np.repeat(np.arange(len(found)), [len(x) for x in found]), n)
    key, count = np.unique(flat[at] * len(found) + doc, return_counts=True)
    while (count > 65535).any():  # a count that one posting can't hold is split
        big = count > 65535
        key, count = np.concatenate([key, key[big]]), np.concatenate([np.where(big, 65535, count), count[big] - 65535])
    by_key = np.argsort(key, kind="stable")
    key, count = key[by_key], count[by_key]
    data = np.empty(len(key), POSTING)
    data["doc"], data["n"] = key % len(found), count
    starts = np.searchsorted(key, np.arange(len(names) + 1) * len(found))
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(edges)).tolist():
        a, z = int(edges[p]), int(edges[p + 1])
        own = starts[a : z + 1]
        yield p, "\0".join([names[i] for i in order[a:z]]), (own - own[0]).astype("<u4").tobytes(), data[own[0] : own[-1]].tobytes()


def _posting(path: str, parts: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        pre = PreTokens(path)

        def made(doc_ids: list, n_bytes: list, found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            rows = list(zip(*_posted(pre, found, parts), strict=True))
            if rows:
                n = len(rows[0])
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array([block] * n, pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.binary()), pa.array(rows[3], pa.binary()), pa.nulls(n, LISTED), pa.nulls(n, LISTED)], FIELDS)
            yield pa.RecordBatch.from_arrays([pa.array([block % parts], pa.int32()), pa.array([block], pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([doc_ids], LISTED), pa.array([n_bytes], LISTED)], FIELDS)

        doc_ids, n_bytes, found, held = [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py() or ""
                doc_ids.append(doc_id)
                n_bytes.append(len(text.encode()))
                found.append(pre.numbers(text))
                held += len(text)
                if held > MOST_TEXT or len(found) >= MOST_DOCS:
                    yield from made(doc_ids, n_bytes, found)
                    doc_ids, n_bytes, found, held, block = [], [], [], 0, block + 1
                    pre.clear()
        if found:
            yield from made(doc_ids, n_bytes, found)

    return run


SUMMED = "block bigint, partial binary, doc_ids array<bigint>, n_bytes array<bigint>"


def _counting(path: str, most_held: int = 8_000_000) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
        known: dict[str, int] = {}
        sums: dict[int, np.ndarray] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            packed = []
            for total in sums.values():
                at = np.flatnonzero(total)
                data = np.empty(len(at), PARTIAL)
                data["doc"], data["n"] = at, total[at]
                packed.append(data.tobytes())
            none = pa.nulls(len(packed), LISTED)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(packed, pa.binary()), none, none], ["block", "partial", "doc_ids", "n_bytes"])
            sums.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("block", "words", "starts", "postings")}
                if row["words"] is None:
                    head = batch.slice(i, 1)
                    yield pa.RecordBatch.from_arrays([head.column("block"), head.column("postings"), head.column("doc_ids"), head.column("n_bytes")], ["block", "partial", "doc_ids", "n_bytes"])
                    continue
                words = row["words"].split("\0")
                for w in set(words).difference(known):
                    known[w] = 1 if w in special else len(tokenizer.model.tokenize(w))
                pieces = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                data = np.frombuffer(row["postings"], POSTING)
                amount = data["n"] * np.repeat(pieces, np.diff(np.frombuffer(row["starts"], "<u4")))
                total = np.bincount(data["doc"], amount).astype(np.int64)
                held = sums.get(row["block"], total[:0])
                if len(held) < len(total):
                    held, total = total, held
                held[: len(total)] += total
                sums[row["block"]] = held
                if len(known) > MOST_KEPT:
                    known.clear()
            if sum(map(len, sums.values())) > most_held:
                yield from flushed()
        if sums:
            yield from flushed()

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in runs(batches, ["block"]):
        docs = group.filter(group.column("doc_ids").is_valid())
        doc_ids = docs.column("doc_ids").combine_chunks().flatten()
        total = np.zeros(len(doc_ids), np.int64)
        for packed in group.column("partial").drop_null():
            data = np.frombuffer(packed.as_py(), PARTIAL)
            total[data["doc"]] += data["n"]
        yield pa.RecordBatch.from_arrays([doc_ids, docs.column("n_bytes").combine_chunks().flatten(), pa.array(total)], ["doc_id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row (doc_id, n_bytes, n_tokens) for each document: the number of tokens of its whole text.

    Documents give pre-token frequencies, a block of documents one posting (document in the block, frequency) for each
    distinct pre-token and document. A hash deals pre-tokens into parts, and a block's postings of one part travel as one
    row. So each distinct pre-token comes to one task, which counts its pieces once and joins the count to the postings
    of all blocks; the sums return to the blocks. No ids are made. A null text counts as empty; rows that repeat a doc_id
    or have none are counted for themselves; an empty table gives none; only doc_id and text are read.
    """
    n = partitions(docs.sparkSession)
    postings = docs.select("doc_id", "text").mapInArrow(_posting(tokenizer_path, max(256, 4 * n)), POSTED)
    sums = postings.repartition(n, "part").mapInArrow(_counting(tokenizer_path), SUMMED)
    return sums.repartition(n, "block").sortWithinPartitions("block").mapInArrow(_totals, "doc_id bigint, n_bytes bigint, n_tokens bigint")
