"""Line dedup, n-gram join, mixing, packing, tokens and quality against brute force on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.fixtures import DOCS, corpus, docs
from tidemark.llm import common, line_dedup, mixing, ngram_join, packing, quality, tokens

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def public(name):
    """The path of a public tokenizer; tests that need one are skipped where there are none."""
    return pytest.importorskip("public_tokenizers").path(name)


def brute_lines(rows, min_chars=40, min_docs=5):
    key = lambda line: line.strip(BLANKS).translate(LOWER)
    holders = defaultdict(set)
    for d, t, _ in rows:
        if d is not None:
            for line in (t or "").split("\n"):
                holders[key(line)].add(d)
    gone = {k: max(v) for k, v in holders.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = []
    for d, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or d >= gone.get(key(x), d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def plain(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup(spark, seed):
    rows = corpus(seed)
    got = line_dedup.dedup_lines(docs(spark, rows))
    assert set(got.columns) == {c.split()[0] for c in DOCS.split(", ")} | {"n_lines"}
    found = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in got.collect()]
    assert plain(found) == plain(brute_lines(rows))
    assert any(r[2] for r in found)


def test_line_bitmaps_of_long_documents(spark):
    line = "x" * 50
    rows = [(i, "\n".join([line if (i + k) % 3 == 0 else f"{i} {k}" for k in range(200)]), "s") for i in range(6)]
    maps = line_dedup.keep_bitmaps(docs(spark, rows)).collect()
    assert {r["doc_id"] for r in maps} == set(range(5))
    for r in maps:
        bits = [w * 64 + b for w, x in r["dropped"].items() for b in range(64) if x >> b & 1]
        assert sorted(bits) == [k for k in range(200) if (r["doc_id"] + k) % 3 == 0] and r["n_dropped"] == len(bits)


def grams(text, n=5):
    words = (text or "").lower().split()
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute_join(rows, threshold=0.8):
    known = [(d, grams(t)) for d, t, _ in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (d, a) in enumerate(known):
        for j, (e, b) in enumerate(known[:i]):
            if d is not None and e is not None and a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(known):
        least[find(i)].append(d)
    return [(d, None if d is None else min(least[find(i)]), links[i]) for i, (d, _) in enumerate(known)]


@pytest.mark.parametrize("tiles", [(512, 256), (3, 2)])
def test_ngram_join(spark, tiles):
    rows = corpus(3)
    got = ngram_join.similar_documents(docs(spark, rows), bucket_rows=tiles[0], cluster_rows=tiles[1]).collect()
    found = [(r["doc_id"], r["class_id"], r["n_links"]) for r in got]
    assert plain(found) == plain(brute_join(rows))
    assert sum(r[2] for r in found) > 20


def test_one_of_each_keeps_columns(spark):
    rows = corpus(3)
    got = ngram_join.one_of_each(docs(spark, rows))
    assert got.columns == [c.split()[0] for c in DOCS.split(", ")]
    want = [d for d, c, _ in brute_join(rows) if d is None or c >= d]
    assert sorted(map(str, (r["doc_id"] for r in got.collect()))) == sorted(map(str, want))


def test_one_row_of_each_group_stays(spark):
    import corpus_pipeline

    rng = np.random.default_rng(2)
    text = lambda: " ".join(f"w{i}" for i in rng.integers(0, 10**6, 60))
    a, b, c = text(), text(), text()
    # Repeated rows, near copies that share an id, copies without id, one of them beside a row with id.
    rows = [(1, a, "s"), (1, a, "s"), (2, b, "s"), (2, b + " more", "s"), (None, c, "s"), (None, c, "s"), (None, a, "s"), (9, text(), "s"), (None, "", "s"), (None, "", "s")]
    got = corpus_pipeline.one_of_near_duplicates(spark, docs(spark, rows), "").collect()
    found = Counter((r["doc_id"], (r["text"] or "")[:20]) for r in got)
    assert found == Counter([(1, a[:20]), (2, b[:20]), (None, c[:20]), (9, rows[7][1][:20]), (None, ""), (None, "")])


def test_mixed_rows_that_repeat_an_id_keep_their_sources(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text, "a"), (1, text, "b"), (None, text, "c"), (None, text, "a"), (2, text + " x", "b")]
    got, want = Counter(), Counter()
    for r in mixing.mixed_documents(docs(spark, rows), block_words=7).collect():
        got[r["source"]] += len(words(r["text"]))
    for r in mixing.taken(docs(spark, rows), block_words=7).collect():
        want[r["source"]] += r["taken"]
    assert got == want


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.8, 0.9):
        bands, rows = ngram_join.bands_for(threshold, 0.999, 400)
        assert 1 - (1 - threshold**rows) ** bands >= 0.999 and bands * rows <= 400


def test_common_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(9)]
    assert (ngram_join.common_counts(sets[:4], sets[4:]) == [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:4]]).all()


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def brute_targets(size, weights=(3, 1, 2), share=1.5, most=2.0):
    order = sorted(size, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), share * sum(size.values())
    while True:
        over = {s for s in free if left * w[s] / sum(w[x] for x in free) > most * size[s]}
        if not over:
            return target | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        for s in over:
            target[s] = most * size[s]
            left -= target[s]
        free -= over
        if not free:
            return target


@pytest.mark.parametrize("block", [7, 512])
def test_mixing(spark, block):
    rows = corpus(4)
    got = mixing.taken(docs(spark, rows), block_words=block).collect()
    assert plain([(r["doc_id"], r["size"]) for r in got]) == plain([(d, len(words(t))) for d, t, _ in rows])
    size, taken = Counter(), Counter()
    for _, t, s in rows:
        size[s] += len(words(t))
    want = brute_targets(size)
    for r in got:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)
    again = mixing.taken(docs(spark, rows).repartition(3), block_words=block).collect()
    assert plain(map(tuple, again)) == plain(map(tuple, got))


def test_mixing_tells_rows_without_words_apart(spark):
    rows = [(1, None, "a"), (1, "", "a"), (1, " ", "a"), (1, " ", "a"), (None, "", None), (None, "", None), (2, "x y", "a"), (2, "x y", "a")]
    got = mixing.taken(docs(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(d), len(words(t))) for d, t, _ in rows)


def spark_hash(*values, seed=42):
    """xxhash64 of strings and integers as Spark chains them: nulls leave the hash as it is."""
    for v, width in values:
        if v is not None:
            data = v.encode() if width is None else int(v).to_bytes(width, "little", signed=True)
            seed = xxhash.xxh64_intdigest(data, seed=seed)
    return seed - 2**64 if seed >= 2**63 else seed


def brute_shuffled(index, size, keys):
    for r in range(mixing.ROUNDS):
        partner = (spark_hash(("mix", None), *keys, (r, 4)) % size - index) % size
        if spark_hash(("swap", None), *keys, (r, 4), (max(index, partner), 8)) % 2 == 0:
            index = partner
    return index


def brute_mix(rows, block):
    """(taken words of each row, {(source, shard): slots}) by the method's definition, slot by slot."""
    size = [len(words(t)) for _, t, _ in rows]
    total = Counter()
    for (_, _, s), n in zip(rows, size, strict=True):
        total[s] += n
    goal = {s: math.floor(t + 0.5) for s, t in brute_targets(total).items()}
    use, slots = {}, {}
    for s in total:
        n, left, slot = -(-total[s] // block), goal[s], 0
        use[s] = Counter()
        while left > 0:
            b = brute_shuffled(slot % n, n, [(s, None), (slot // n, 8)])
            take = min(left, block if b < n - 1 else total[s] - (n - 1) * block)
            for w in range(b * block, b * block + take):
                use[s][w] += 1
            left -= take
            slot += 1
        slots[s] = slot
    order, at, drawn = sorted(total, key=lambda s: (s is None, s)), 0, Counter()
    every = sum(slots.values())
    for s in order:
        for i in range(slots[s]):
            drawn[s, brute_shuffled(at + i, every, [("draw", None)]) % 8] += 1
        at += slots[s]
    buckets, first, out = max(1, math.ceil(math.sqrt(len(rows)))), Counter(), {}

    def place(i):
        d, t, _ = rows[i]
        keys = [(-1 if d is None else d, 8), *([(spark_hash((t, None)), 8)])]
        draw = spark_hash(("mix", None), *keys)
        return ((draw % 2**64) >> 20) % buckets, draw, -1 if d is None else d, spark_hash((t, None))

    for i in sorted(range(len(rows)), key=place):
        s = rows[i][2]
        out[i] = sum(use[s][w] for w in range(first[s], first[s] + size[i]))
        first[s] += size[i]
    return [out[i] for i in range(len(rows))], drawn


@pytest.mark.parametrize("block", [7, 64])
def test_mixing_equals_brute_force(spark, block):
    rows = [r for i, r in enumerate(corpus(4)) if r not in corpus(4)[:i]]
    taken, drawn = brute_mix(rows, block)
    got = mixing.taken(docs(spark, rows), block_words=block).collect()
    assert plain((r["doc_id"], r["size"], r["taken"]) for r in got) == plain((d, len(words(t)), n) for (d, t, _), n in zip(rows, taken, strict=True))
    assert all((r["first_shard"] is None) == (r["taken"] == 0) for r in got)
    uses, _ = mixing.mix(docs(spark, rows), block_words=block)
    found = uses.collect()
    assert Counter((r["source"], r["shard"]) for r in found) == drawn
    assert len({(r["source"], r["epoch"], r["block"]) for r in found}) == len(found) and min(r["take"] for r in found) > 0
    own = [r["block"] for r in sorted(found, key=lambda r: r["slot"]) if r["source"] == "a"]
    assert own != sorted(own)


def test_another_draw_gives_shards_other_words(spark):
    """The draw decides what stands in an output shard; what is taken of each document in all stays."""
    rows = [r for i, r in enumerate(corpus(4)) if r not in corpus(4)[:i]]
    one, two = (mixing.taken(docs(spark, rows), block_words=7, draw=d).collect() for d in ("draw", "other"))
    assert plain((r["doc_id"], r["taken"], r["target"]) for r in one) == plain((r["doc_id"], r["taken"], r["target"]) for r in two)
    assert plain((r["doc_id"], r["first_shard"]) for r in one) != plain((r["doc_id"], r["first_shard"]) for r in two)
    _, drawn = brute_mix(rows, 7)
    held, other = ({(r["source"], r["shard"]): (r["n_slots"], r["words"]) for r in mixing.shard_contents(docs(spark, rows), block_words=7, draw=d).collect()} for d in ("draw", "other"))
    assert {k: n for k, (n, _) in held.items()} == drawn and held != other
    assert sum(w for _, w in held.values()) == sum(w for _, w in other.values()) == sum(r["taken"] for r in one)


def test_token_files_spread_rows_without_ids(spark):
    """Rows that have no doc_id, or all the same one, lie in all parts, equal texts included."""
    for rows in ([(None, f"text {i % 40}", "a") for i in range(400)], [(7, "same", "a")] * 400):
        folder = tokens.token_folder(spark, "t")
        tokens.write_token_files(docs(spark, rows), public("byte_bpe_50k.json"), folder, files=4)
        parts = [r["n"] for r in spark.read.schema(tokens.ENCODED).orc(folder).groupBy("part").agg(F.count("*").alias("n")).collect()]
        assert len(parts) == 4 and max(parts) < 200 and sum(parts) == 400
        got = tokens.read_token_files(spark, folder).orderBy("start").collect()
        assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:i]) for i in range(400)]


def test_shuffled_is_a_permutation(spark):
    for n in (1, 2, 3, 100, 257):
        place = mixing.shuffled(F.col("id"), F.lit(n), [F.lit("k")])
        got = spark.range(n).select(place.alias("p"), mixing.shuffled(place, F.lit(n), [F.lit("k")], inverse=True).alias("back"), "id").collect()
        assert sorted(r["p"] for r in got) == list(range(n)) and all(r["back"] == r["id"] for r in got)


def test_draws_are_multinomial_given_the_totals(spark):
    plan = spark.createDataFrame([("a", 6000), (None, 3000), ("b", 1000)], "source string, slots bigint")
    counts = {(r["source"], r["shard"]): r["n_slots"] for r in mixing.shard_counts(plan, 100, 8).collect()}
    per = Counter()
    for (_, shard), n in counts.items():
        per[shard] += n
    assert set(per.values()) == {100} and len(per) == 100
    share = np.array([counts.get(("a", h), 0) for h in range(100)])
    # Given the totals a share of 0.6 in 100 slots varies by nearly 24.
    assert share.sum() == 6000 and 14 < share.var() < 36


def test_mixed_documents_hold_the_words_taken(spark):
    rows = [r for i, r in enumerate(corpus(4)) if r not in corpus(4)[:i]]
    mixed = mixing.mixed_documents(docs(spark, rows), block_words=7)
    assert mixed.columns == [c.split()[0] for c in DOCS.split(", ")]
    got = defaultdict(int)
    for r in mixed.collect():
        got[r["doc_id"], r["source"]] += len(words(r["text"]))
    want = defaultdict(int)
    for r in mixing.taken(docs(spark, rows), block_words=7).collect():
        want[r["doc_id"], r["source"]] += r["taken"]
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def brute_pack(lengths, sizes=packing.SIZES, cost=packing.sequence_cost):
    bins, out = [], []
    for i, n in enumerate(lengths):
        fits = [(room, b) for b, (room, _) in enumerate(bins) if room >= n]
        if fits:
            least = min(room for room, _ in fits)
            own = [b for room, b in fits if room == least]
            # Of equal room the bin that got it last.
            b = max(own, key=lambda b: bins[b][1])
        else:
            def each(s):
                coming = max(0, sum(x for x in lengths[i + 1 :] if x <= s - n) - sum(r for r, _ in bins))
                return cost(s) / (n + min(s - n, coming))
            b = len(bins)
            bins.append((min((s for s in sorted(sizes) if s >= n), key=each), 0))
        bins[b] = (bins[b][0] - n, i + 1)
        out.append(b)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_pack_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    lengths = np.sort(rng.integers(1, [200, 4096, 600, 1500][seed] + 1, 150))[::-1]
    bins, offsets, final = packing.pack(lengths)
    assert bins.tolist() == brute_pack(lengths.tolist())
    for b in set(bins.tolist()):
        own = np.flatnonzero(bins == b)
        total = lengths[own].sum()
        assert sorted(offsets[own]) == sorted(np.cumsum(lengths[own]) - lengths[own])
        assert set(final[own]) == {min(s for s in packing.SIZES if s >= total)}


def test_rows_without_id_are_packed_in_many_shards(spark):
    got = packing.packed(docs(spark, [(None, f"w {i}", "a") for i in range(200)]), shard_pieces=20).collect()
    assert len({r["bin_id"] >> 32 for r in got}) > 5 and sum(r["n_tokens"] for r in got) == 400


def test_packing_keeps_every_token(spark):
    rows = corpus(5) + [(900, "w " * 9000, "a")]
    got = packing.packed(docs(spark, rows), shard_pieces=20).collect()
    held = Counter()
    for r in got:
        held[r["doc_id"]] += r["n_tokens"]
        assert r["start"] == r["piece"] * 4096
    want = Counter()
    for d, t, _ in rows:
        want[d] += len(words(t))
    assert held == Counter({k: v for k, v in want.items() if v})
    bins = defaultdict(list)
    for r in got:
        bins[r["bin_id"]].append((r["offset"], r["n_tokens"], r["bin_size"]))
    for own in bins.values():
        at = 0
        for offset, n, _ in sorted(own):
            assert offset == at
            at += n
        assert {s for *_, s in own} == {min(s for s in packing.SIZES if s >= at)}


ODD_TEXTS = ["a  b", "a\n\nb \n c", "\x1cx\x85", "it's 42% <|endoftext|> ok", "<|startoftext|>\tX", "日本 語́ é", " lead", "trail ", "\r\n", "İstanbul ẞ", "a\xa0b", "don't!!  ...", "x" * 3000]


def token_rows():
    return corpus(6)[:40] + [(500 + i, t, "a") for i, t in enumerate(ODD_TEXTS)] + corpus(6)[-10:]


def test_token_files(spark):
    rows = token_rows()
    path = public("byte_bpe_50k.json")
    folder = tokens.token_folder(spark, "test")
    tokens.write_token_files(docs(spark, rows), path, folder, files=3)
    got = [tuple(r) for r in tokens.token_file_checksums(tokens.read_token_files(spark, folder)).orderBy("start").collect()]
    from tokenizers import Tokenizer

    lib, at, want = Tokenizer.from_file(path), 0, []
    for d, t in sorted(((d, t) for d, t, _ in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode())):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    only = spark.read.schema(tokens.ENCODED).orc(folder).where("doc_id = 7")
    assert only.count() == 1


def test_look_up_tables_give_the_librarys_ids():
    """Texts of any white space, zero characters, special strings and scripts, while tables start to forget."""
    path, draw = public("byte_bpe_50k.json"), random.Random(5)
    some = ["a", "b", " ", "\n", "\t", "\0", "ß", "\xa0", "\u2003", "\x1c", "9", ".", "'s", "<|endoftext|>", "<", "\r", "é", "日", "  ", "\n\n", "🙂", "\u0301", "\x85"]
    texts = ["", "\0", *("".join(draw.choice(some) for _ in range(draw.randint(0, 12))) for _ in range(20_000))]
    encoder, counter = tokens.IdEncoder(path), tokens.TokenCounter(path)
    encoder.most_kept = counter.most_kept = 500
    want = [np.asarray(x.ids, "<u4").tobytes() for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for at in range(0, len(texts), 999):
        assert encoder.encode(texts[at : at + 999]) == want[at : at + 999]
        assert counter.count(texts[at : at + 999]) == [len(x) // 4 for x in want[at : at + 999]]
    assert encoder.encode([]) == [] and counter.count([]) == []


def test_look_up_tables_hold_a_word_once(tmp_path):
    """A word is one piece whatever mark or line feed stands beside it, and a special string is never cut."""
    from tokenizers import Tokenizer

    path, draw = public("byte_bpe_50k.json"), random.Random(6)
    words = ["".join(draw.choice("abcdefgé") for _ in range(9)) for _ in range(300)]
    beside = ["{} ", "{}, ", "{}. ", "{}! ", "{}### ", "{}.\n", "{}\n"]
    texts = ["".join(b.format(w) for w in words) + "end" for b in beside]
    some = ["a", "ö", " ", "\n", ".", ",", "'", "'s", "'t", "***", "%", "$", "<|endoftext|>", "<|", "|>", "<a,b>", "#", "7", "!", "?", ":", "ª", "×", "_", "日", "\u0301", "\xad", " ."]
    texts += ["".join(draw.choice(some) for _ in range(draw.randint(0, 14))) for _ in range(5000)]
    lib = Tokenizer.from_file(path)
    lib.add_special_tokens(["<a,b>"])
    lib.save(f"{tmp_path}/special.json")
    for file in (path, f"{tmp_path}/special.json"):
        encoder, counter = tokens.IdEncoder(file), tokens.TokenCounter(file)
        want = [np.asarray(x.ids, "<u4").tobytes() for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert encoder.encode(texts[:7]) == want[:7] and counter.count(texts[:7]) == [len(x) // 4 for x in want[:7]]
        if file == path:  # each word at a text's or line's beginning, and after a space
            assert len(encoder.known) < 2 * len(set(words)) + 20
        assert encoder.encode(texts) == want and counter.count(texts) == [len(x) // 4 for x in want]


def test_token_counts(spark):
    rows = token_rows()
    path = public("word_bpe_49k.json")
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path)
    want = [(d, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for d, t, _ in rows]
    assert plain(tuple(r) for r in tokens.count_tokens(docs(spark, rows), path).collect()) == plain(want)


def test_packing_query_counts_tokens(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    from tidemark.llm import queries

    rows = [*token_rows(), (900, "unbroken" * 6000, "a"), (901, "two words " * 4000, "a")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    lib, want = Tokenizer.from_file(public("byte_bpe_50k.json")), []
    for d, t, _ in rows:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        want += [(d, at // 4096, at, min(4096, n - at)) for at in range(0, n, 4096)]
    for got in (queries.op3_packing(spark, str(tmp_path)), corpus_pipeline.packed_sequences(spark, docs(spark, rows), str(tmp_path))):
        found = got.collect()
        assert plain((r["doc_id"], r["piece"], r["start"], r["n_tokens"]) for r in found) == plain(want)
        full = Counter()
        for r in found:
            full[r["bin_id"]] += r["n_tokens"]
        assert all(full[r["bin_id"]] <= r["bin_size"] for r in found)


def test_counts_beyond_one_posting(spark):
    path = public("word_bpe_49k.json")
    got = tokens.count_tokens(docs(spark, [(1, "go " * 200_000, "a")]), path).first()
    assert got["n_tokens"] == 200_000


def labelled(spark, n=600):
    """Prose is good; the same words over and over are not."""
    import random

    from tests.llm.fixtures import WORDS, prose

    rng, rows, labels = random.Random(8), [], []
    for i in range(n):
        good = rng.random() < 0.7
        rows.append((i, prose(rng, 60) if good else " ".join([rng.choice(WORDS)] * 60), "a"))
        labels.append((i, int(good)))
    return rows, spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id bigint, quality int")


def test_quality_on_held_out_documents(spark):
    rows, labels = labelled(spark)
    truth = {r["doc_id"]: r["quality"] for r in labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").collect()}
    got = quality.scored(docs(spark, rows + [(9000, None, "a"), (9001, "", "a"), (None, "x y", None)]), labels)
    scores = {r["doc_id"]: r["score"] for r in got.select("row.doc_id", "score").collect()}
    assert len(scores) == 603 and all(0 <= s <= 1 for s in scores.values()) and scores[9000] == scores[9001]
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(scores[i] >= 0.3) == truth[i] for i in held]) > 0.95


def test_scores_are_the_networks(spark, tmp_path):
    """Each row's score by hand from the fitted network, and the pipeline's first stage by these scores, with real labels."""
    import corpus_pipeline

    rows, labels = labelled(spark, 200)
    rows += [(9000, None, "a"), (9001, "", None), (None, rows[0][1], "a"), (3, rows[1][1], "b")]
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs(spark, rows).select(*corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    vectors, net = quality.quality_model(table, labels)

    def score(text):
        x = [(float(a) - m) / s for a, m, s in zip(quality.features(text, vectors), net.mean, net.scale, strict=True)]
        hidden = [math.tanh(sum(a * w for a, w in zip(x, column, strict=True)) + b) for column, b in zip(net.w1.T, net.b1, strict=True)]
        logit = sum(h * w for h, w in zip(hidden, net.w2, strict=True)) + net.b2
        return 1 / (1 + math.exp(-max(-30, min(30, logit / net.temperature))))

    want = {t: score(t) for t in {t for _, t, _ in rows}}
    got = quality.scored(table, labels).select("row.doc_id", "row.text", "score").collect()
    assert len(got) == len(rows) and all(abs(r["score"] - want[r["text"]]) < 1e-6 for r in got)
    assert {w < 0.3 for w in want.values()} == {True, False} and min(abs(w - 0.3) for w in want.values()) > 1e-6
    kept = corpus_pipeline.good_documents(spark, table, str(tmp_path)).collect()
    assert plain((r["doc_id"], r["text"], r["source"]) for r in kept) == plain(r for r in rows if want[r[1]] >= 0.3)


def test_word_vectors_and_features_equal_brute_force(spark):
    """Vectors and pooled features by their definition, neighbour by neighbour."""
    texts = [t for _, t, _ in corpus(8)[:30]] + ["Same same same, SAME!! $$$ x$$$ | y", "one", "", None]
    place, sign = quality.index_vectors()
    bucket = lambda x: xxhash.xxh64_intdigest(x.encode()) % quality.BUCKETS
    cut = [[bucket(x) for x in re.findall(r"\w+|[^\w\s]+", t or "")] for t in texts]
    total = np.zeros((quality.BUCKETS, quality.WIDTH))
    for own in cut:
        for a, b in zip(own, own[1:], strict=False):
            for k in range(quality.NONZERO):
                total[a, (place[b, k] + 1) % quality.WIDTH] += sign[b, k]
                total[b, (place[a, k] - 1) % quality.WIDTH] += sign[a, k]
    want = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-6)
    got = quality.word_vectors(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]).repartition(3))
    assert np.abs(got - want).max() < 1e-6
    for own, t in zip(cut, texts, strict=True):
        x = want[own].reshape(-1, quality.WIDTH)
        pooled = np.concatenate([x.mean(0), x.var(0), (x[1:] * x[:-1]).sum(0) / len(x)]) if own else np.zeros(quality.POOLED)
        assert np.abs(quality.features(t, got) - pooled).max() < 1e-5
        assert np.abs(quality.features(t, got, at_once=3) - pooled).max() < 1e-5


def test_temperature_calibrates():
    """Noisy labels: probabilities follow frequencies, and on new rows the temperature does better than none."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 40))
    p = 1 / (1 + np.exp(-1.5 * x[:, 0] - x[:, 1] * x[:, 2]))
    y = (rng.random(6000) < p).astype(float)
    net = quality.fitted(x[:1500], y[:1500])
    logits, truth = net.logits(x[1500:]), y[1500:]
    loss = lambda t: np.mean(np.logaddexp(0, logits / t) - truth * logits / t)
    assert net.temperature != 1 and loss(net.temperature) < loss(1.0) - 0.01
    scores = net.scores(x[1500:])
    bins = np.digitize(scores, [0.2, 0.4, 0.6, 0.8])
    assert max(abs(scores[bins == b].mean() - truth[bins == b].mean()) for b in range(5)) < 0.15


def test_labels_are_bounded_at_any_size(spark):
    few = spark.range(4000).select(F.xxhash64("id").alias("k"))
    for n, most in ((10**5, 20_000), (10**11, 8192), (10**15, 16_384)):
        bound = common.hash_share(n, most, "k")
        share = few.where(bound).count() / 4000
        assert abs(share - most / n) < 0.03
        # The bound is a place in the hash range, which is not rounded to nothing.
        width = int(re.search(r"-\d{5,}", str(bound))[0]) + 2**63
        assert abs(width / 2**64 * n - most) < 1
    rows, labels = labelled(spark, 60)
    same = docs(spark, [(7, f"text {i}", "a") for i in range(50)] + rows)
    vectors, net = quality.quality_model(same, labels)
    assert net.w1.shape[0] == quality.POOLED


def test_names_with_dots_and_very_long_texts(spark):
    """A text of 300,000 words beside short ones, and columns whose names hold dots and backticks."""
    long = " ".join(f"w{i % 5000}x{i // 7}" for i in range(300_000))
    rows = [(1, long, "a"), (2, long + " end", "a"), (3, "short one\n" + "y" * 50, "b"), *[(10 + i, f"z{i}\n" + "y" * 50, "b") for i in range(5)]]
    table = docs(spark, rows).withColumn("a.b", F.lit(5)).withColumn("c`d", F.lit(6))
    lines = line_dedup.dedup_lines(table)
    assert {r["doc_id"]: r["n_dropped"] for r in lines.collect()} == {1: 0, 2: 0, 3: 1, 10: 1, 11: 1, 12: 1, 13: 1, 14: 0}
    assert sorted(r["doc_id"] for r in ngram_join.one_row_of_each(table).collect()) == [1, 3, 10, 11, 12, 13, 14]
    mixed = mixing.mixed_documents(table, shard="out")
    assert {"a.b", "c`d", "out"} <= set(mixed.columns) and mixed.where("`a.b` = 5 AND out IS NOT NULL").count() == mixed.count() > 0
    assert sum(r["taken"] for r in mixing.taken(table).collect()) == round(sum(r["target"] for r in mixing.taken(table).select("source", "target").distinct().collect()))
    labels = spark.createDataFrame([(i, i % 2) for i in range(10, 15)], "doc_id bigint, quality int")
    assert quality.scored(table, labels).select("row.*", "score").count() == 8


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    got = quality.scored(docs(spark, [(1, "a b", "s"), (2, None, "s")]), none)
    assert {r["score"] for r in got.collect()} == {0.5}


def test_empty_tables(spark):
    none = docs(spark, [])
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert line_dedup.dedup_lines(none).count() == 0
    assert ngram_join.similar_documents(none).count() == 0
    assert mixing.taken(none).count() == 0
    assert mixing.mixed_documents(none).count() == 0
    assert packing.packed(none).count() == 0
    assert quality.scored(none, labels).count() == 0


def test_empty_tables_have_no_tokens(spark):
    none = docs(spark, [])
    assert tokens.count_tokens(none, public("word_bpe_49k.json")).count() == 0
    folder = tokens.token_folder(spark, "empty")
    tokens.write_token_files(none, public("byte_bpe_50k.json"), folder)
    assert tokens.read_token_files(spark, folder).count() == 0


def test_line_sql(spark, tmp_path):
    import duckdb

    from tidemark.llm import queries

    rows = [(i, t, s) for i, (_, t, s) in enumerate(corpus(7))]
    docs(spark, rows).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op4_line_dedup(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()["op4_line_dedup"]).fetchall()
    assert plain(tuple(r) for r in got) == plain(want)
    assert plain((r["doc_id"], r["kept_sha256"]) for r in got) == plain((d, hashlib.sha256(t.encode()).hexdigest()) for d, _, _, t in brute_lines(rows))


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows, labels = labelled(spark, 200)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs(spark, rows + [(9000, rows[0][1], "b"), (9001, None, None)]).select(*columns).write.parquet(f"{tmp_path}/documents.parquet")
    now, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert now.columns == columns
            assert now.where(F.col("n_chars") != F.length("text")).count() == 0 or name in ("quality",)
        ids.append({r["doc_id"] for r in now.select("doc_id").distinct().collect()})
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    assert len(ids[0] & good) >= 0.95 * len(good) and ids[1] == ids[0] and 9000 not in ids[2]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    # Without labels every document scores 0.5 and passes.
    docs(spark, corpus(9)).select(*corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    now, after = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        after[name] = now.collect()
    held = {name: [(r["doc_id"], r["text"], r["source"]) for r in after[name]] for name in ("quality", "lines", "near_duplicates", "mix")}
    assert plain(held["quality"]) == plain(corpus(9))
    assert plain((d, t or "") for d, t, _ in held["lines"]) == plain((d, t) for d, _, _, t in brute_lines(corpus(9)))
    # Rows are numbered, so that those without an id or with a repeated one are members of groups too.
    groups = defaultdict(list)
    for i, c, _ in brute_join([(i, t, s) for i, (_, t, s) in enumerate(held["lines"])]):
        d, t, _ = held["lines"][i]
        groups[c].append((d is None, d or 0, d))
    assert plain(r[0] for r in held["near_duplicates"]) == plain(min(g)[2] for g in groups.values())
    assert len(held["near_duplicates"]) < len(held["lines"])
    size, taken = Counter(), Counter()
    for _, t, s in held["near_duplicates"]:
        size[s] += len(words(t))
    for _, t, s in held["mix"]:
        taken[s] += len(words(t))
    want = brute_targets(size)
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)
    lib, cut = Tokenizer.from_file(public("byte_bpe_50k.json")), []
    for d, t, _ in held["mix"]:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        cut += [(d, at // 4096, at, min(4096, n - at)) for at in range(0, n, 4096)]
    assert plain((r["doc_id"], r["piece"], r["start"], r["n_tokens"]) for r in after["packing"]) == plain(cut)
    # One shard: its bins are those of the pieces in the order of their lengths.
    lengths, bins, found = sorted((r[3] for r in cut), reverse=True), defaultdict(list), defaultdict(list)
    for n, b in zip(lengths, brute_pack(lengths), strict=True):
        bins[b].append(n)
    for r in after["packing"]:
        found[r["bin_id"], r["bin_size"]].append(r["n_tokens"])
    wanted = Counter((min(s for s in packing.SIZES if s >= sum(b)), *sorted(b)) for b in bins.values())
    assert Counter((size, *sorted(b)) for (_, size), b in found.items()) == wanted
    assert plain(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == plain(map(tuple, after["packing"]))
