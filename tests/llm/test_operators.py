"""The training-data operators against brute force, round trips and held-out labels, on small tables with awkward rows."""

import hashlib
import re
import zlib
from base64 import b32encode
from collections import Counter
from itertools import combinations
from math import floor

import numpy as np
import pyarrow as pa
import pytest

from placewise.llm.common import read_table

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars int"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def docs(spark):
    """The smallest documents, and rows with nulls, no text, ties, repeats, very long text; extra columns with common names."""
    base = read_table(spark, SMALL, "documents").selectExpr("doc_id", "text", "lang", "source", "cast(n_chars as int) n_chars")
    long = " ".join(f"w{k * 7919 % 99991}" for k in range(60_000))
    odd = [
        (10_000, None, None, None, None), (10_001, "", "en", None, 0), (10_002, " \n\t ", None, "src0", 3), (10_003, "One two", "en", "src0", 7),
        (10_004, "one TWO", "en", None, 7), (10_005, "one two three four five", "en", "z", 23), (10_006, long, "en", "src1", len(long)),
        (10_007, long + " end", "en", "src1", len(long) + 4), (10_007, long + " end", "en", "src1", len(long) + 4), (10_003, "one two three", "en", "src0", 13),
        (None, "a text without an id that nobody repeats", "en", "src0", 40), (None, None, None, None, None), (10_008, "1234 !!", None, "", 7),
        (10_009, "é" * 3000, "fr", "é", 3000), (10_010, " ".join(["same"] * 500), "en", "src0", 2500),
    ]
    df = base.union(spark.createDataFrame(odd, DOCS))
    return df.selectExpr("*", "'x' AS rank", "1 AS size", "2 AS score", "'p' AS path", "3 AS taken", "4 AS block", "5 AS key").checkpoint()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text, r.source) for r in docs.collect()]


def shingle_set(text):
    w = WORD.findall(low(text))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def parts_of(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_pairs(items):
    for k, (a, s) in enumerate(items):
        for b, t in items[k + 1 :]:
            if s and t and 100 * min(len(s), len(t)) >= 85 * max(len(s), len(t)):
                both = len(s & t)
                if 100 * both >= 85 * (len(s) + len(t) - both):
                    yield a, b


def test_near_duplicates(docs, rows):
    from placewise.llm.neardup import near_duplicates

    sets = [(i, shingle_set(t)) for i, t, _ in rows if i is not None]
    part = parts_of({i for i, _ in sets}, near_pairs(sets))
    want = Counter((i, len(shingle_set(t)), part.get(i), i is None or part[i] == i) for i, t, _ in rows)
    assert Counter(map(tuple, near_duplicates(docs).collect())) == want


def test_near_duplicates_in_a_crowd(spark):
    """A group of near copies, all of different text: chains and gaps at the threshold, in one bucket."""
    from placewise.llm.neardup import keep_one, near_duplicates

    rng = np.random.default_rng(1)
    base, made = [f"b{k}" for k in range(120)], []
    for k in range(300):
        words = list(base)
        for at in rng.choice(120, int(rng.integers(0, 5)), replace=False):
            words[at] = f"x{k}_{at}"
        made.append((k, " ".join(words)))
    df = spark.createDataFrame(made, "doc_id long, text string")
    sets = [(i, shingle_set(t)) for i, t in made]
    part = parts_of(range(300), near_pairs(sets))
    assert {r.doc_id: r.component_id for r in near_duplicates(df).collect()} == part
    assert {r.doc_id for r in keep_one(df).collect()} == set(part.values())


def test_blocks_of_a_bucket(spark, monkeypatch):
    """Cells of many small blocks find what one cell finds."""
    from placewise.llm import neardup

    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", 7)
    words = [f"t{k}" for k in range(100)]
    made = [(k, " ".join(words[:90] + [f"y{k}"] + words[90:])) for k in range(60)]
    got = {r.component_id for r in neardup.near_duplicates(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got == {0}


def test_top_k(spark):
    from placewise.llm.topk import top_k

    vectors = [(r.vec_id, r.embedding) for r in read_table(spark, SMALL, "embeddings").collect()]
    vectors += [(20_000, None), (20_050, [0.5, float("nan")]), (20_100, [None, 1.0]), (20_150, [0.25, -1.0]), (20_150, [0.25, -1.0]), (None, [1.0] * 64), (20_200, [float("inf")]), (20_250, [])]
    vectors += [(30_000 + k, [0.5] * 64) for k in range(60)]  # ties
    got = top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<double>").selectExpr("*", "1 AS rank", "2 AS v"), every=50, k=5).collect()
    sound = {i: [floor(256 * x) for x in v] for i, v in vectors if i is not None and v is not None and all(x is not None and abs(x) < 1e30 for x in v)}
    want = []
    for q in (i for i in sound if i % 50 == 0):
        scored = sorted((-sum(a * b for a, b in zip(sound[q], v, strict=False)), i) for i, v in sound.items() if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


def test_top_k_of_nothing(spark):
    from placewise.llm.topk import top_k

    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<double>")).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 511, 512, 513, 3000])
def test_elias_fano(n):
    from placewise.llm.eliasfano import EliasFano

    values = np.sort(np.random.default_rng(n).integers(0, 50 * n * n + 1, n))
    code = EliasFano.from_bytes(EliasFano.of(values).to_bytes())
    assert (code.all() == values).all() and [code.select(k) for k in range(n)] == values.tolist()
    assert len(EliasFano.of(values).to_bytes()) <= 24 + n * (2.5 + np.log2(max(2, values.max(initial=1) / max(n, 1)))) / 4 + 64


def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")


def test_encoder_is_exact():
    from tokenizers import Tokenizer

    from placewise.llm.tokens import Encoder

    bits = [" ", " ", "  ", "\n", "\t", "a", "foo", "Bar,", "'s", "12", "é", " ", " ", "!!", "<|endoftext|>", "日本", "\r\n", "\x1c", "\x85", "ſ", "x@y.z"]
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(bits, rng.integers(0, 20))) for _ in range(4000)] + [None, "", " ", " a", "a "]
    plain = Tokenizer.from_file(tokenizer())
    ids, size = Encoder(tokenizer()).encode(pa.array(texts))
    assert [i.tolist() for i in np.split(ids, np.cumsum(size)[:-1])] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_token_ids(docs, rows):
    from tokenizers import Tokenizer

    from placewise.llm.tokens import token_ids

    plain, at = Tokenizer.from_file(tokenizer()), 0
    coded = [(i, plain.encode(t or "", add_special_tokens=False).ids + [2]) for i, t, _ in rows]
    got = sorted(token_ids(docs, tokenizer()).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in coded), key=lambda i: (i is not None, i or 0))
    for r in got:
        assert r.start == at
        at += r.n_tokens
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(c), crc(c)) for i, c in coded)


def test_mixture(docs, rows):
    from placewise.llm.mixture import mixed_documents, taken_words, targets

    assert targets([100, 0, 1]) == pytest.approx([98, 0, 3]) and targets([]) == []
    found = taken_words(docs).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, targets([sizes[s] for s in names]), strict=True))
    assert sum(goal.values()) == pytest.approx(sum(sizes.values()))
    want = Counter((i, len(WORD.findall(t or "")), sizes[s], round(goal[s], 6)) for i, t, s in rows)
    assert Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6)) for r in found) == want
    assert all(r.taken <= 3 * r["size"] for r in found)
    taken = Counter()
    for r in found:
        taken[(r.source_size, round(r.target, 6))] += r.taken
    for s in names:
        assert abs(taken[(sizes[s], round(goal[s], 6))] - goal[s]) <= max(8, 0.02 * goal[s])
    assert Counter(map(tuple, taken_words(docs).collect())) == Counter(map(tuple, found))  # reruns agree
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r.source] += len(WORD.findall(r.text))
    assert all(abs(words[s] - goal[s]) <= max(8, 0.02 * goal[s]) for s in names)


def test_shard_counts_add_up():
    from placewise.llm.mixture import permuted, shard_counts

    slots, shards = [1000, 0, 77, 5], [shard_counts(k, [1000, 0, 77, 5], 64, 3) for k in range(17)]
    at = np.zeros(4, int)
    for before, have in shards:
        assert (before == at).all() and have.sum() <= 64
        at = at + have
    assert at.tolist() == slots
    for n in (1, 2, 3, 17, 1000):
        assert sorted(permuted(np.arange(n), n, 9).tolist()) == list(range(n))


def test_secrets(docs, rows, spark):
    from placewise.llm.secrets import find_secrets

    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    tricky = ["secret=token:abcdefgh", "PassWd : 'x1'", "toKen=abcdef", "toKen = \"abcdef\"", "AKIA" + "A" * 15, "AKIA" + "B7" * 8, "é0123456789abcdef01234567x", "deadbeef" * 3]
    learn = [(k, f"say password={hashlib.sha1(str(k).encode()).hexdigest()[:18]} now") for k in range(100)] + [(500, "alone " + hashlib.sha1(b"q").hexdigest()[:18] + " here")]
    df = docs.select("doc_id", "text", "rank").union(spark.createDataFrame([(*r, "x") for r in [*enumerate(tricky, 40_000), *learn]], "a long, b string, c string"))
    texts = [(i, t) for i, t, _ in rows] + list(enumerate(tricky, 40_000)) + learn
    want = Counter()
    for i, t in texts:
        t = t or ""
        found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
        line = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))
        want[(i, *[sum(f[1] == k for f in found) for k in range(3)], hashlib.sha256(line.encode()).hexdigest())] += 1
    got = find_secrets(df).collect()
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    assert next(r.spans for r in got if r.doc_id == 500) == "format:6:24"


def test_language(docs, spark):
    from placewise.llm.langid import languages

    found = {r.doc_id: r for r in languages(docs).collect()}
    assert (found[10_000].lang_pred, found[10_008].lang_pred, found[10_001].lang_pred) == ("und", "und", "und")
    assert all(0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found.values())
    table = read_table(spark, "/root/testdata/sf0.01", "documents")
    truth = {r.doc_id: r.lang for r in table.select("doc_id", "lang").collect()}
    held = [r for r in languages(table).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held) > 0
    assert {r.lang_pred for r in languages(docs.withColumn("lang", docs.lang.substr(9, 1)).filter("doc_id < 5 and lang <> ''")).collect()} <= {"und"}


def test_quality(docs, spark):
    from placewise.llm.quality import keep_good, quality_scores

    folder = "/root/testdata/sf0.01"
    table, labels = read_table(spark, folder, "documents"), read_table(spark, folder, "labels")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in quality_scores(table, labels).collect() if r.held_out and r.doc_id in truth]
    good, bad = [r.score for r in held if truth[r.doc_id]], [r.score for r in held if not truth[r.doc_id]]
    assert np.mean([a > b for a in good for b in bad]) > 0.97 and np.mean([s >= 0.3 for s in good]) > 0.97
    odd = quality_scores(docs, labels.withColumn("score", labels.quality)).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in odd)
    assert keep_good(docs, labels).columns == docs.columns
    assert {r.score for r in quality_scores(docs, labels.limit(0)).collect()} == {0.5}


def test_decontamination(spark, docs):
    from placewise.llm.decontaminate import keep_clean, overlaps

    bench = read_table(spark, SMALL, "benchmark").select("item_id", "text").collect()
    item = bench[0].text.split()
    swapped = [w if k % 7 != 3 else "other" for k, w in enumerate(item)]
    pad = [f"q{k}" for k in range(100)]
    made = [
        (50_000, " ".join(pad + item + pad)), (50_001, " ".join(pad + swapped + pad).upper()), (50_002, " ".join(pad)), (50_003, None),
        (50_004, " ".join(pad[:20] + item[:6] + pad[20:])), (50_005, " ".join(item)), (50_006, " ".join(pad + ["tiny", "item", "of", "five", "words"])), (None, " ".join(item + pad)),
    ]
    table = spark.createDataFrame(made, "doc_id long, text string").selectExpr("*", "1 AS start", "2 AS hash")
    marks = spark.createDataFrame([(r.item_id, r.text) for r in bench] + [(900, "Tiny item of five words!"), (901, None), (902, "two words")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in overlaps(table, marks).collect()}
    first = bench[0].item_id
    assert found == {(50_000, first), (50_001, first), (50_005, first), (50_006, 900), (None, first)}
    assert {r.doc_id for r in keep_clean(table, marks).collect()} == {50_002, 50_003, 50_004}
    # against brute force on the given rows: every document that holds an item's words in a row is found
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", low(t))
    lines = [(r.item_id, " " + " ".join(words(r.text)) + " ") for r in bench]
    want = {(r.doc_id, i) for r in docs.filter("doc_id < 10000").select("doc_id", "text").collect() for i, line in lines if line in " " + " ".join(words(r.text)) + " "}
    got = {(r.doc_id, r.item_id) for r in overlaps(docs.filter("doc_id < 10000"), marks.filter("item_id < 900")).collect()}
    assert want <= got and len(got) <= 1.2 * len(want) + 2
    assert overlaps(table, marks.limit(0)).collect() == [] and overlaps(table.limit(0), marks).collect() == []


def stretches(equal, n_item):
    """The best (equal words, -words, from) of all stretches that qualify, one by one."""
    need, best = min(12, -(-4 * n_item // 5)), None
    for i in range(len(equal)):
        same = 0
        for j in range(i, len(equal)):
            same += equal[j]
            if same >= need and 5 * same >= 4 * (j - i + 1):
                best = max(best or (0, 0, 0), (same, -(j - i + 1), -i))
    return best


def unseeded(need, most, masks):
    """Patterns of up to ``most`` words, ``need`` and 80 % of them equal, in which no mask finds a seed."""
    bits, lost, states = [(len(m), int(m, 2)) for m in masks], [], {(1, 1): "1"}
    for n in range(1, most + 1):
        states = {k: s for k, s in states.items() if not any(n >= size and k[0] & m == m for size, m in bits)}
        lost += [s for (_, same), s in states.items() if same >= need and 5 * same >= 4 * n]
        states = {(((last << 1) | c) & 1023, same + c): s + str(c) for (last, same), s in states.items() for c in (0, 1)}
    return lost


def test_stretches_that_qualify():
    from fractions import Fraction

    from placewise.llm.decontaminate import best_stretch

    find = lambda equal, need: best_stretch(np.array(equal, bool), need, Fraction(4, 5))
    assert find([k not in (11, 13) for k in range(16)], 12) == (0, 16, 14)
    run, other = [1] * 13, [0] * 6
    assert find(run + other + run + other + run, 12) == (0, 32, 26)
    assert find([1] * 11 + [0] * 9 + [1] * 11, 12) is None and find([0] * 5, 1) is None and find([], 1) is None
    rng = np.random.default_rng(8)
    for _ in range(400):
        equal = (rng.random(int(rng.integers(1, 60))) < rng.choice([0.6, 0.75, 0.9])).astype(int).tolist()
        want = stretches(equal, 59)
        assert find(equal, 12) == (want and (-want[2], -want[2] - want[1], want[0]))


def test_no_long_stretch_without_a_seed():
    from placewise.llm.decontaminate import MASKS, SPAN

    # a stretch of 24 equal words or more can be cut into two, one of which qualifies, so 28 words are enough
    assert unseeded(12, 28, MASKS) == [] and max(map(len, MASKS)) == SPAN


@pytest.mark.parametrize("n", range(1, 15))
def test_no_stretch_of_a_short_item_without_a_seed(n):
    from placewise.llm.decontaminate import SPAN, masks_of

    assert unseeded(min(12, -(-4 * n // 5)), n, masks_of(n)) == [] and max(map(len, masks_of(n))) <= SPAN


def test_decontamination_of_short_items(spark):
    from placewise.llm.decontaminate import overlaps

    made, marks, want = [], [], {}
    for n in range(1, 15):
        words = [f"n{n}w{k}" for k in range(n)]
        marks.append((n, " ".join(words)))
        for k, gone in enumerate([c for size in range(4) for c in combinations(range(n), size)]):
            copy = [f"x{j}" if j in gone else w for j, w in enumerate(words)]
            made.append((1000 * n + k, " ".join(["p"] * 12 + copy + ["q"] * 3)))
            best = stretches([int(j not in gone) for j in range(n)], n)
            if best and n >= 3:
                want[1000 * n + k, n] = (12 - best[2], -best[1], best[0])
    table, items = spark.createDataFrame(made, "doc_id long, text string"), spark.createDataFrame(marks, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, r.n_words, r.n_equal) for r in overlaps(table, items, shortest=3).collect()}
    assert got == want
    assert {k for k, _ in got} >= {9000 + k for k in range(10)}  # any one of nine words exchanged
    assert {(r.doc_id, r.item_id) for r in overlaps(table, items).collect()} == {x for x in want if x[1] >= 5}


def test_decontamination_of_exchanged_words(spark):
    from placewise.llm.decontaminate import overlaps

    rng = np.random.default_rng(15)
    items = {i: [f"i{i}w{k}" for k in rng.integers(0, 40, int(rng.integers(15, 60)))] for i in range(40)}
    made, want = [], {}
    for d in range(400):
        i, rate = d % 40, rng.choice([0.1, 0.15, 0.2, 0.25])
        item = items[i]
        copy = [f"x{d}y{k}" if rng.random() < rate else w for k, w in enumerate(item)][int(rng.integers(0, 6)) :]
        text = [f"p{d}q{k}" for k in range(int(rng.integers(0, 90)))] + copy + [f"r{k}" for k in range(20)]
        made.append((d, " ".join(text)))
        found = []
        for shift in range(-len(item), len(text)):
            low, high = max(0, -shift), min(len(item), len(text) - shift)
            equal = [int(item[k] == text[k + shift]) for k in range(low, high)]
            best = sum(equal) >= 12 and stretches(equal, len(item))
            if best:
                found.append((best[0], best[1], best[2] - low - shift))
        if found:
            same, size, start = max(found)
            want[d, i] = (-start, -size, same)
    table, marks = spark.createDataFrame(made, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    assert 200 < len(want) < 390
    assert {(r.doc_id, r.item_id): (r.start, r.n_words, r.n_equal) for r in overlaps(table, marks).collect()} == want


def test_warc(spark):
    from placewise.llm.warc import archived

    magic = "WARC/1.0\r\n"
    fake = magic + "WARC-Type: response\r\nWARC-Record-ID: <urn:x-page:77>\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    html = [magic, None, "", fake + "tail", "x" + fake + fake, fake + "tail", "\r\n\r\n" + magic + "WARC-Type: response\r\nContent-Length: 3\r\n\r\n", magic * 50 + "é€😀",
            "a" + magic + "Content-Length: 999999\r\nWARC-Type: x\r\n\r\n", "end\r\n\r\n", magic[:-1], magic + "WARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n", "y" * 300_000]
    made = [(10**6 + k, "u\r\n" if k else None, h) for k, h in enumerate(html)] + [(None, "u", "nobody"), (None, "u", "")]
    pages = read_table(spark, SMALL, "pages").select("page_id", "url", "html").union(spark.createDataFrame(made, "page_id long, url string, html string"))
    pages = pages.selectExpr("*", "1 AS size", "2 AS offset", "3 AS sha")
    rows, first = [(r.page_id, (r.html or "").encode()) for r in pages.collect()], {}
    for i, b in rows:
        if i is not None:
            first[b] = min(i, first.get(b, i))
    want = Counter()
    for i, b in rows:
        to = first.get(b) if first.get(b) != i else None
        want[(i, len(b), b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if to is not None else "response", to)] += 1
    got = archived(pages, payloads=True).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want and all(r.sound for r in got)
    texts = dict(rows)
    assert all(bytes(r.payload) == texts[r.page_id] for r in got if r.record_type == "response" and r.page_id is not None)
    assert archived(pages.limit(0)).collect() == []


def test_main_text(spark):
    from placewise.llm.htmltext import extracted, main_text

    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href='/'>Home</a></ul></nav><!-- <p>no</p> --><div class=\"top-banner\">Buy</div>"
        "<article><h1>A &amp; B</h1><p>One <b>two<br>three</p><p>Four&nbsp;five<div class='comments'><p>mine</p></div><form><p>mail</p></form><script>'</p>'</script>six</article><footer>&copy; x</footer>"
    )
    assert main_text(page) == "A & B\n\nOne two three\n\nFour five\n\nsix"
    assert main_text("") == "" and main_text("plain  text") == "plain text" and main_text("<p>a > b <3 c</p>") == "a > b <3 c"
    # a host without article elements: link lists and the line that all pages share are template, what differs is text
    shape = "<div class=x><p><a href=/a>first link</a> <a href=/b>second link</a></p></div><div class=y><p>All rights of this site are reserved.</p></div><div class=z><p>Story number {k} is told here.</p><p>It has {k} parts.</p></div>"
    made = [(k, f"http://h.example/{k}", shape.format(k=k)) for k in range(8)] + [(50, None, None), (51, "http://h.example/", ""), (None, "bad url", "<p>x</p>")]
    table = spark.createDataFrame(made, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS rejected")
    got = {r.page_id: (r.text, r.n_chars) for r in extracted(table).collect()}
    for k in range(8):
        text = f"Story number {k} is told here.\n\nIt has {k} parts."
        assert got[k] == (text, len(text))
    assert got[50] == got[51] == ("", 0) and got[None] == ("x", 1)


def test_template_paths_are_judged_one_by_one(spark):
    from placewise.llm.htmltext import extracted

    # every path stands once on each page: links, a long line that never changes, a text that does
    one = "<div class=x><p><a href=/a>one link</a></p></div><div class=y><p>Rights are reserved.</p></div><div class=z><p>Story {k} is told here at some length.</p></div>"
    links = "<div class=x><p><a href=/a>a very long list of links that outweighs the text</a></p></div><div class=z><p>Story {k}.</p></div>"
    # the first 8,000 characters' worth of blocks are equal, later ones are not
    many = "<div>{k} begins</div>" + "<p>same</p>" * 900 + "<p>part {k}</p>"
    late = "<div>{k} begins</div><p>part {k}</p>" + "<p>same</p>" * 900
    made = [(100 * n + k, f"http://h{n}.example/{k}", shape.format(k=k)) for n, shape in enumerate([one, links, many, late]) for k in range(6)]
    # most pages of a host have an article, all have the same menu; and a host of copies
    made += [(400 + k, f"http://h4.example/{k}", ("<article><p>a</p></article>" if k % 3 else f"<p>Text {k}.</p>") + "<div class=x><a href=/>here</a></div>") for k in range(9)]
    made += [(500 + k, f"http://h5.example/{k}", "<p>A copy.</p><p>Its end.</p>") for k in range(6)]
    got = {r.page_id: r.text for r in extracted(spark.createDataFrame(made, "page_id long, url string, html string")).collect()}
    for k in range(6):
        assert got[k] == f"Story {k} is told here at some length." and got[100 + k] == f"Story {k}."
        same = ["same"] * 900
        assert got[200 + k] == "\n\n".join([f"{k} begins", *same, f"part {k}"]) and got[300 + k] == "\n\n".join([f"{k} begins", f"part {k}", *same])
        assert got[500 + k] == "A copy.\n\nIts end."
    assert [got[400 + k] for k in range(9)] == ["a" if k % 3 else f"Text {k}." for k in range(9)]


def test_rare_paths_follow_the_slot_they_stand_in(spark):
    from placewise.llm.htmltext import extracted, templates

    # a quote on two pages only stands in a slot of links, another in the story; two hosts have too few pages of their own
    menu = "<div class=x><a href=/a>the first of many links</a><a href=/b>the second of many links</a>{extra}</div>"
    shape = menu + "<div class=y>Rights are reserved.</div><div class=z><p>Story {k} is told.</p>{quote}</div>"
    page = lambda k: shape.format(k=k, extra="<blockquote>see</blockquote>" if k < 2 else "", quote="<blockquote>so</blockquote>" if k < 2 else "")
    turned = "<div class=z><p>Story 8 is told.</p></div><div class=y>Rights are reserved.</div><div class=x>text here</div>"
    made = [(k, f"http://h.example/{k}", page(k)) for k in range(8)] + [(8, "http://h.example/8", turned)]
    made += [(100 + k, f"http://few{k}.example/", page(5 + k)) for k in range(2)]
    pages = spark.createDataFrame(made, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extracted(pages).collect()}
    assert got[0] == "Story 0 is told.\n\nso" and got[5] == "Story 5 is told."
    # a page in another order does not fit; a few pages borrow that a line never changes, but no judgement on links
    assert got[8] == "Story 8 is told.\n\nRights are reserved.\n\ntext here"
    assert got[100] == "the first of many linksthe second of many links\n\nStory 5 is told."
    # pages with an article are counted and nested like others
    with_article = spark.createDataFrame([(k, "h", f"<nav><p>menu</p></nav><article><h1>{k}</h1><p>text {k}</p></article>") for k in range(6)], "key long, host string, html string")
    (row,) = templates(with_article).filter("host = 'h'").collect()
    slots = {s["path"]: s for s in row.slots}
    assert {"/nav", "/nav/p", "/article", "/article/h1", "/article/p"} == set(slots) and len({s["class"] for s in row.slots}) == 1
    assert not any(s["template"] for s in row.slots)


@pytest.mark.parametrize(("page", "text"), [
    ("<html><head><title>T</title><body><p>text", "text"),
    ("<html><head><title>T</title><meta name=x><p>text", "text"),
    ("<head><title>T</title>text", "text"),
    ("<head><noscript><img src=x><body><p>text", "text"),
    ("<head><title>T</title><script>var a = '</head><p>no';</script></head><p>text", "text"),
    ("<head></head><body><div><button>Go</div><p>text</p></body>", "text"),
    ("<body><p>one <button>Go<p>two</body>", "one\n\ntwo"),
    ("<div><button>Go</div><p>text</p><div><button>Go</button> end</div>", "text\n\nend"),
    ("<p>one</p><select><option>x<p>two", "one\n\ntwo"),
    ("<ul><li><video src=x>none</ul><p>text", "text"),
    ("<p>Press <button>OK</button> now <noscript><p>no</p></noscript>here", "Press now here"),
    ("<p>a<svg><svg><title>t</title></svg><text>x</text></svg>b<object><div><p>no</div></object>c", "abc"),
    ("<p>one<script>two<p>three", "one"),
    ("<body class='has-sidebar'><p>text", "text"),
    ("<div id='content' class='with-sidebar'><p>text</p></div>", "text"),
    ("<body><article class='widget'><p>text</p></article>", "text"),
    ("<article class='widget-content'><p>text</p></article>", "text"),
    ("<main id='search-trees'><p>text</p></main>", "text"),
    ("<p>text</p><div class='wide sidebar'>no</div><div id=cookie-notice><p>no</p></div><div class='ad-1'>no</div>", "text"),
])
def test_main_text_of_loose_pages(page, text):
    from placewise.llm.htmltext import main_text

    assert main_text(page) == text


def test_many_unclosed_elements_take_one_pass():
    from placewise.llm.htmltext import main_text

    assert main_text("<svg><p>" * 50_000 + "end") == "end"


def test_pipeline_stages(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = read_table(spark, folder, "documents")
    kept = docs
    ids = {r.doc_id for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, folder).checkpoint()
        assert kept.columns == docs.columns
        now = {r.doc_id for r in kept.collect()}
        assert now <= ids
        ids = now
    sets = [(r.doc_id, shingle_set(r.text)) for r in kept.collect()]
    assert list(near_pairs(sets)) == []
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in out} <= ids and len(out) >= 0.8 * len(ids)
