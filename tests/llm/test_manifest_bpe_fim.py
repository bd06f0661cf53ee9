"""Operators 11 to 13: the manifest, the transducer and fill-in-middle, against brute force, the library and round trips."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import corpus, docs, prose
from tidemark.llm import fim, merkle, transducer
from tidemark.llm import queries as corpus_queries

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, text):
    doc_id, source, lang, n_chars, _ = row
    return H(*map(field, (doc_id, source, lang, n_chars, text)))


def grown(digests):
    """(root, for each leaf its list of (place, siblings))."""
    paths, places, now = [[] for _ in digests], list(range(len(digests))), digests
    while len(now) > 1:
        for i, at in enumerate(places):
            run = now[at // 16 * 16 : at // 16 * 16 + 16]
            paths[i].append((at % 16, run[: at % 16] + run[at % 16 + 1 :]))
        now = [H(*now[i : i + 16]) for i in range(0, len(now), 16)]
        places = [at // 16 for at in places]
    return now[0], paths


def manifest(rows):
    """Brute force: rows of merkle.CHECKED for rows (doc_id, source, lang, n_chars, text)."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees.append((own, *grown([leaf(r, r[4]) for r in own])))
    root, above = grown([t[1] for t in trees]) if trees else (None, [])
    out = []
    for (own, subroot, paths), top in zip(trees, above, strict=True):
        for row, path in zip(own, paths, strict=True):
            whole, text = path + top, row[4]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            digest = leaf(row, text)
            for at, siblings in whole:
                digest = H(*siblings[:at], digest, *siblings[at:])
            out.append((row[0], leaf(row, row[4]), subroot, root, H(*(x for _, s in whole for x in s)), digest, digest == root))
    return out


def checked(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    clash = frame.withColumns({c: F.lit(1) for c in ("tree", "place", "block", "at", "digest", "number", "row", "n")})
    return clash, [tuple(r) for r in merkle.verified(clash, F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()]


def in_sql(frame, tmp_path, sql):
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    return con.execute(sql).fetchall()


def ordered(rows):
    return sorted(rows, key=repr)


def test_manifest_equals_brute_force(spark, tmp_path):
    """A source of three levels, one whose last run has one leaf, lone leaves, more sources than one run, nulls and repeats."""
    rng = random.Random(4)
    rows = [(i, "big", None, i, f"Text {i}") for i in range(300)] + [(i, "odd", "en", None, "A\nB") for i in range(1000, 1017)]
    rows += [(2000 + i, f"s{i}", "é", 3, prose(rng, 5).title()) for i in range(20)] + [(3000, None, None, None, None), (None, "big", None, 1, "Q"), (None, "big", None, 1, "Q"), (None, None, None, None, None), (7, "big", None, 7, "Text 7"), (7, "big", None, 7, "Other"), (5, "-", "", 0, "")]
    rng.shuffle(rows)
    frame, got = checked(spark, rows)
    assert ordered(got) == ordered(manifest(rows))
    assert {r[-1] for r in got} == {True, False}
    assert ordered(got) == ordered(in_sql(frame, tmp_path, merkle.manifest_sql()))


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(5, "a", "b", 1, "X")], [(i, "a", None, 0, "x") for i in range(17)], [(1, "a", None, 0, "x"), (1, "b", None, 0, "x")]])
def test_manifest_of_small_tables(spark, rows):
    assert ordered(checked(spark, rows)[1]) == ordered(manifest(rows))


def test_a_changed_leaf_or_sibling_is_found(spark):
    root, paths = grown([H(str(i)) for i in range(40)])
    for i, path in enumerate(paths):
        packed = b"".join(merkle.packed(at, [bytes.fromhex(x) for x in s]) for at, s in path)
        assert merkle.folded(bytes.fromhex(H(str(i))), packed).hex() == root
        assert merkle.folded(bytes.fromhex(H("else")), packed).hex() != root
        assert [(a, [x.hex() for x in s]) for a, s in merkle.steps(packed)] == path


def test_manifest_plans_no_large_group(spark):
    """A node has 16 children at most, also where one source has all documents."""
    leaves = spark.range(5000).select(F.lit(0).cast("bigint").alias("tree"), F.col("id").alias("place"), F.lit(5000).cast("bigint").alias("width"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    levels, roots = merkle.climbed(spark, leaves, 5000)
    assert [x.count() for x in levels] == [313, 20, 2, 1] and roots.count() == 1
    assert max(r[0] for x in levels for r in x.select(F.size("children")).collect()) == 16
    assert roots.first()["digest"].hex() == grown([H(str(i)) for i in range(5000)])[0]


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = transducer.read_ranks(RANKS)
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_transducer_equals_the_library_on_pieces(library):
    ranks, encoding = library
    machine, rng = transducer.Transducer(ranks), random.Random(5)
    tokens = list(ranks)
    some = [b"a", b"th", b"the", b" ", b"ing", "é".encode(), b"\xe2\x82", b"aa", b"==", "😀".encode()]
    for k in range(6000):
        kind = k % 3
        data = b"".join(rng.choice(some if kind else tokens) for _ in range(rng.randint(1, 12))) if kind < 2 else bytes(rng.randrange(256) for _ in range(rng.randint(1, 9)))
        for _ in range(1 + k % 4):  # moves are kept when they are missed again
            assert machine.encode_piece(data) == encoding._core_bpe.encode_single_piece(data)


def test_transducer_with_small_tables(library):
    """Tables that are full again and again, inside pieces too, change nothing; neither does a very long piece."""
    ranks, encoding = library
    machine = transducer.Transducer(ranks)
    machine.most_moves, machine.most_missed, machine.most_pairs, machine.most_pieces = 3, 9, 5, 4
    rng = random.Random(6)
    encoders = [transducer.TextEncoder(machine, public_tokenizers.PATTERN, cut) for cut in (True, False)]
    encoders[0].most_kept = 3
    for text in [prose(rng, 60), "x" * 3000, "ab" * 2000, " " * 500 + "a", "", "\n\n a\r\n\t b", "I'll don't 12 345 …—", "日本語 текст", "a\x1cb\x85c \u180e d", "\0 x\n\0", "a \u2003b\u3000 c\t\td  e\n f"]:
        for encoder in encoders:
            assert np.frombuffer(encoder.encode([text])[0], "<i4").tolist() == encoding.encode_ordinary(text)


def test_tokens_are_written_after_a_bounded_lookahead(library):
    """What a state still holds back is never longer than the longest token."""
    ranks, _ = library
    machine, rng = transducer.Transducer(ranks), random.Random(7)
    longest = max(map(len, ranks))
    for _ in range(50):
        data = prose(rng, 30).replace(" ", "").encode()
        for _ in range(40):
            machine.encode_piece(data)
    assert len(machine.states) > 1000
    held = [sum(len(machine.token[i]) for i in tokens) for _, threads in machine.states for _, tokens in threads]
    assert max(held) <= longest
    with pytest.raises(ValueError):
        transducer.Transducer({b"a": 0})


def test_decoding_streams(library):
    ranks, encoding = library
    machine, text = transducer.Decoder(ranks), "añ😀 日本 \u0000 ﷽ 😀😀é" * 20
    ids = np.array([i for b in text.encode() for i in [ranks[bytes((b,))]]], np.int32)
    for step in (1, 2, 3, 7, 1000):
        parts = list(machine.stream(ids[i : i + step] for i in range(0, len(ids), step)))
        assert "".join(parts) == text
    whole = np.array(encoding.encode_ordinary(text), np.int32)
    assert "".join(machine.stream([whole[:5], whole[5:]])) == text
    for bad in (b"\xff", b"a\xc3", b"\xed\xa0\x80", b"\xc0\x80", b"\xf4\x90\x80\x80", b"\xe0\x80\x80"):
        with pytest.raises(ValueError):
            list(machine.stream([np.array([ranks[bytes((b,))] for b in bad], np.int32)]))
    with pytest.raises(ValueError):
        list(machine.stream([np.array([60000], np.int32)]))


def test_state_machine_of_utf8_is_pythons():
    for code in [*range(0, 0x3000, 7), 0xD7FF, 0xE000, 0xFFFF, 0x10000, 0x10FFFF]:
        state = 0
        for b in chr(code).encode():
            state = transducer._utf8_step(state, b)
        assert state == 0


def test_bpe_query(spark, library, tmp_path):
    rows = corpus() + [(900, "x" * 200_000, "a"), (901, "é\n" * 5000, None), (902, "<|endoftext|>", "a")]
    frame = docs(spark, rows)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in corpus_queries.op12_byte_bpe(spark, str(tmp_path)).collect()]
    want = []
    for doc_id, text, _ in rows:
        ids = library[1].encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert ordered(got) == ordered(want)
    apart = transducer.decode(transducer.encode(frame, RANKS, public_tokenizers.PATTERN), RANKS)
    assert ordered((r["doc_id"], r["text"]) for r in apart.collect()) == ordered((d, t or "") for d, t, _ in rows)
    assert transducer.decode(transducer.encode(frame.limit(0), RANKS, public_tokenizers.PATTERN), RANKS).count() == 0


def shaped(doc_id, text):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h4 % 100 < 50
    return len(units), "spm" if spm else "psm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    odd = ["\n", "\n\n\n", "a", "a\n", "\na", "<P", "<P> x", "<\n<S", "<S><M>", "é😀\n" * 700, "x" * 70_000, "\r\n\x0b  y", "<<\n>>\nS>\nM>"]
    rows = corpus() + [(500 + i, t, "a") for i, t in enumerate(odd)] + [(600 + i, "\n".join(prose(rng, rng.randint(0, 4)) for _ in range(rng.randint(1, 400))), "b") for i in range(20)]
    frame = docs(spark, rows)
    got = fim.fill_in_middle(frame)
    want = [(d, *shaped(d, t or "")) for d, t, _ in rows]
    assert ordered(tuple(r) for r in got.collect()) == ordered(want)
    back = fim.restored(got)
    assert ordered((r["doc_id"], r["text"]) for r in back.select("doc_id", "text").collect()) == ordered((d, t or "") for d, t, _ in rows)
    sql = in_sql(frame, tmp_path, fim.FIM_SQL)
    assert ordered(tuple(r) for r in corpus_queries.op13_fill_in_middle(spark, str(tmp_path)).collect()) == ordered(sql)
    assert fim.restored(fim.fill_in_middle(frame.limit(0))).count() == 0


@pytest.mark.parametrize("every", [1, 2, 7, 64])
@pytest.mark.parametrize("scanned", [1, 5, 64, 1 << 16])
def test_line_index(every, scanned):
    rng = random.Random(every * 100 + scanned)
    for _ in range(20):
        text = "".join(rng.choice(["a", "é", "😀", "\n", "bc"]) for _ in range(rng.randint(0, 150)))
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        index = fim.LineIndex(text.encode(), every, scanned)
        assert index.n == len(units) and len(index.bytes) <= index.n // every + 1
        for u in range(len(units) + 1):
            before = "".join(units[:u])
            assert index.cut(u) == (len(before.encode()), len(before))


def test_plans_that_leave_documents_alone():
    data = b"one\ntwo\nthree"
    forms = [fim.shape(data, i, fim.Plan(seed=1, shaped=40, spm=0)).form for i in range(300)]
    assert set(forms) == {"plain", "psm"} and 80 < forms.count("psm") < 160
    with pytest.raises(ValueError):
        fim.restore(b"nothing", "psm")
