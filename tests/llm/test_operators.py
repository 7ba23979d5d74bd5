"""The training-data operators against brute force, libraries, SQL twins and labels, on small fixtures."""

import functools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def corpus(spark):
    """Copies, near copies, shared passages, one huge group, nulls, empty and long texts, repeated ids."""
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["Straße", "Ünï", "a", "the"]
    passage = " ".join(rnd.choices(vocabulary, k=40))
    rows = []

    def add(text, source="s1", lang="en"):
        rows.append((len(rows), text, lang, source, len(text or "")))

    base = [rnd.choices(vocabulary, k=rnd.randint(6, 120)) for _ in range(40)]
    for words in base:
        add(" ".join(words), rnd.choice(["s1", "s2", "Ä", None]))
        for _ in range(rnd.randint(0, 4)):
            near = list(words)
            for _ in range(rnd.randint(0, max(1, len(words) // 20))):
                near[rnd.randrange(len(near))] = rnd.choice(vocabulary)
            add("\n".join([" ".join(near[:5]), " ".join(near[5:]).upper()]), rnd.choice(["s1", "s2"]))
    for _ in range(60):
        add(" ".join(rnd.choices(vocabulary, k=rnd.randint(5, 60))) + " " + passage)
    for i in range(120):
        add(passage + f" tail{i % 30}")
    for text in (None, "", " \t\n", "one", "one", "one two three four", "ONE two three four", " x", "long " * 30000, " ".join(f"u{i}" for i in range(20000))):
        add(text, None, None)
    rows.append((3, rows[3][1], "en", "s1", 1))
    rows.append((None, base[0][0], None, None, None))
    rows.append((None, None, None, None, None))
    return spark.createDataFrame(rows, DOCS).repartition(5).cache(), rows


def empty(spark):
    return spark.createDataFrame([], DOCS)


def twin(sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    return con.execute(sql).df()


def shingles(text):
    w = words_of((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(ids, linked):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def brute_jaccard(rows):
    sets = [(r[0], shingles(r[1])) for r in rows if r[0] is not None]
    linked = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if x and y and 100 * len(x & y) >= 75 * len(x | y)]
    return components({a for a, _ in sets}, linked), sets


@pytest.mark.parametrize("cell_tokens, run, fan", [(4_000_000, 512, 64), (1500, 3, 2)])
def test_jaccard_matches_brute_force(spark, corpus, monkeypatch, cell_tokens, run, fan):
    """Also where connected sets are dealt to blocks, crowded tokens chain their groups, and counts are summed in a tree."""
    from quarry.llm import jaccard_groups

    for name, value in (("CELL_TOKENS", cell_tokens), ("RUN", run), ("FAN", fan)):
        monkeypatch.setattr(jaccard_groups, name, value)
    docs, rows = corpus
    out = jaccard_groups.jaccard_components(docs).collect()
    root, sets = brute_jaccard(rows)
    assert len(out) == len(rows)
    assert Counter((r.doc_id, r.component_id) for r in out if r.doc_id is not None) == Counter((a, root[a]) for a, _ in sets)
    assert Counter((r.doc_id, r.n_shingles) for r in out if r.doc_id is not None) == Counter((a, len(x)) for a, x in sets)
    assert {r.component_id for r in out if r.doc_id is None} == {None}


def test_jaccard_keeps_one_of_each_group(spark, corpus):
    from quarry.llm import jaccard_groups

    docs, rows = corpus
    kept = jaccard_groups.one_of_each_group(docs)
    root, _ = brute_jaccard(rows)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(root.values()))
    assert ids.count(None) == 2
    assert jaccard_groups.jaccard_components(empty(spark)).collect() == []


def test_jaccard_matrix_takes_nine_bytes_a_token(spark, corpus):
    """What the matrix's shuffle carries: 4 bytes of a token below its bucket and 5 of a group."""
    import numpy as np

    from quarry.llm import jaccard_groups

    docs, rows = corpus
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").selectExpr("doc_id", "CAST(text AS binary) AS text")
    matrix = texts.mapInArrow(jaccard_groups._matrix(np.zeros(1 << jaccard_groups.SLOT_BITS, np.uint16), 16), "bucket int, tokens binary, groups binary").collect()
    tokens, groups = (sum(len(r[c]) for r in matrix) for c in ("tokens", "groups"))
    _, sets = brute_jaccard(rows)
    most = sum(len(s) - (75 * len(s) + 99) // 100 + 1 for _, s in sets if s)
    assert 0 < tokens + groups <= 9 * most and 5 * tokens == 4 * groups


@pytest.mark.parametrize("words", [1, 1 << 17])
def test_jaccard_shuffles_only_texts_in_doubt(spark, corpus, monkeypatch, words):
    """Rows that stay and do not repeat pass without an exchange, whatever the filter lets through."""
    from quarry.llm import jaccard_groups

    monkeypatch.setattr(jaccard_groups, "DOUBT_WORDS", words)
    found, apart = [], jaccard_groups._apart
    monkeypatch.setattr(jaccard_groups, "_apart", lambda *a: found.append(apart(*a)) or found[-1])
    docs, rows = corpus
    docs = docs.union(docs.where("doc_id % 7 = 0"))
    ids = [r.doc_id for r in jaccard_groups.one_of_each_group(docs).collect()]
    root, _ = brute_jaccard(rows)
    assert sorted(i for i in ids if i is not None) == sorted(set(root.values()))
    sure, rest = found[0]
    assert "Exchange hashpartitioning" not in sure._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    times = Counter(a for a, _ in (tuple(r)[:2] for r in docs.select("doc_id", "text").collect()) if a is not None)
    single = {i for i in ids if i is not None and times[i] == 1}
    got = {r.id for r in sure.collect()}
    assert got <= single and {r.id for r in rest.collect()} >= set(times) - single
    assert words == 1 or len(got) > 0.9 * len(single)


@pytest.mark.parametrize("cell_tokens", [4_000_000, 400])
def test_jaccard_repeated_ids_with_different_texts(spark, monkeypatch, cell_tokens):
    """Rows of one id with different texts are documents of their own, in one cell and across cells."""
    from quarry.llm import jaccard_groups

    monkeypatch.setattr(jaccard_groups, "CELL_TOKENS", cell_tokens)

    rnd, rows = random.Random(8), []
    for family in range(12):
        words = [f"f{family}x{i}" for i in range(80)]
        for _ in range(12):
            rows.append((rnd.randrange(30), " ".join(words)))
            words = list(words)
            for _ in range(rnd.randint(0, 2)):
                words[rnd.randrange(len(words))] = f"n{rnd.randrange(10**6)}"
    rows += [(500, f"lone text {i} with words of its own") for i in range(3)] + [(501, ""), (501, None), (501, "five words and one more"), (3, rows[0][1].upper())]
    sets = [shingles(t) for _, t in rows]
    linked = [(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if x and y and 100 * len(x & y) >= 75 * len(x | y)]
    # rows without a shingle link with nothing, but equal rows of an id are one
    root = components(range(len(rows)), [*linked, *[(i, j) for i in range(len(rows)) for j in range(i) if rows[i][0] == rows[j][0] and sets[i] == sets[j]]])
    least = defaultdict(lambda: 1 << 60)
    for i, (doc, _) in enumerate(rows):
        least[root[i]] = min(least[root[i]], doc)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = jaccard_groups.jaccard_components(df).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == Counter((d, len(sets[i]), least[root[i]]) for i, (d, _) in enumerate(rows))
    kept = jaccard_groups.one_of_each_group(df).collect()
    at = {row: root[i] for i, row in enumerate(rows)}
    assert Counter(at[(r.doc_id, r.text)] for r in kept) == Counter(set(root.values()))
    assert all(r.doc_id == least[at[(r.doc_id, r.text)]] for r in kept)


def test_jaccard_fifty_tables_with_repeated_ids(spark):
    """Fifty tables of words of their own, whose ids repeat with other texts; columns that clash with the results."""
    from quarry.llm import jaccard_groups

    rnd, rows = random.Random(21), []
    for table in range(50):
        words = [f"t{table}w{rnd.randrange(40)}" for _ in range(rnd.randint(5, 60))]
        for _ in range(rnd.randint(2, 9)):
            near = list(words)
            for _ in range(rnd.randint(0, 3)):
                near[rnd.randrange(len(near))] = f"t{table}x{rnd.randrange(60)}"
            rows.append((rnd.randrange(60), " ".join(near), "a", table))
    sets = [shingles(r[1]) for r in rows]
    linked = [(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if 100 * len(x & y) >= 75 * len(x | y)]
    root, least = components(range(len(rows)), linked), {}
    for i, r in enumerate(rows):
        least[root[i]] = min(least.get(root[i], r[0]), r[0])
    out = jaccard_groups.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string, component_id string, n int").repartition(4)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == Counter((r[0], len(sets[i]), least[root[i]]) for i, r in enumerate(rows))
    assert 20 < len(linked)


def test_link_forest_of_blocks_and_outsiders():
    """Blocks with the leaders of the whole, then outsiders against each block, find what one cell finds."""
    from quarry.llm.jaccard_groups import link_forest

    rnd = np.random.default_rng(4)
    base = [rnd.integers(0, 2**56, 60).astype(np.uint64) for _ in range(6)]
    sets = []
    for i in range(300):
        s = base[min(int(rnd.exponential(1)), 5)].copy()
        s[rnd.integers(0, 60, rnd.integers(0, 14))] = rnd.integers(0, 2**56)
        sets.append(np.unique(s))
    whole = link_forest(sets).roots()
    leaders, block = [5, 77, 140, 210], rnd.integers(0, 4, 300)
    links = []
    for b in range(4):
        at = np.unique(np.concatenate([np.flatnonzero(block == b), leaders]))
        found = link_forest([sets[i] for i in at], chosen=[int(np.searchsorted(at, x)) for x in leaders]).roots()
        links += [(int(at[i]), int(at[r])) for i, r in enumerate(found)]
    root = components(range(300), links)
    largest = Counter(root.values()).most_common(1)[0][0]
    outer = [i for i in range(300) if root[i] != largest]
    assert outer
    for b in range(4):
        at = np.unique(np.concatenate([np.flatnonzero(block == b), outer]))
        found = link_forest([sets[i] for i in at], outside=np.searchsorted(at, outer)).roots()
        links += [(int(at[i]), int(at[r])) for i, r in enumerate(found)]
    assert components(range(300), links) == dict(enumerate(whole.tolist()))


def test_jaccard_tiny_difference_at_threshold(spark):
    from quarry.llm.jaccard_groups import jaccard_components

    a = [f"a{i}" for i in range(11)]  # 7 shingles; one word more at the end gives 7 of 8, four more 7 of 11
    rows = [(1, " ".join(a)), (2, " ".join([*a, "x"])), (3, " ".join([*a, "p", "q", "r", "s"]))]
    out = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in out.collect()} == {1: 1, 2: 1, 3: 3}


def brute_embeddings(rows):
    """(n_links, component_id) of each row (id, vector, label), by all pairs."""

    def unit(v):
        v = np.array(v, np.float64)
        return v / np.linalg.norm(v)

    fit = [(n, unit(v), k) for n, (i, v, k, *_) in enumerate(rows) if i is not None and k is not None and v is not None and None not in v and np.isfinite(np.array(v)).all() and any(v)]
    links, count = [], defaultdict(int)
    for n, (i, u, k) in enumerate(fit):
        for j, w, m in fit[:n]:
            if k == m and len(u) == len(w) and u @ w >= 0.98:
                links.append((i, j))
                count[i] += 1
                count[j] += 1
    root, least = components(range(len(rows)), links), {}
    for n, r in enumerate(rows):
        if r[0] is not None:
            least[root[n]] = min(least.get(root[n], r[0]), r[0])
    return [(count[n], least.get(root[n])) for n in range(len(rows))]


def assert_embeddings(out, rows):
    expected = Counter((r[0], n, c, r[0] is not None and r[0] == c) for r, (n, c) in zip(rows, brute_embeddings(rows), strict=True))
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in out) == expected


@pytest.mark.parametrize("block", [None, 8])
def test_embeddings_match_brute_force(spark, block):
    from quarry.llm.embed_dedup import near_duplicates

    rnd = np.random.default_rng(3)
    rows = []
    for centre in rnd.normal(size=(12, 8)):
        for _ in range(12):
            rows.append((len(rows), [float(x) for x in (centre + rnd.normal(scale=rnd.choice([0.02, 0.08, 0.3]), size=8)).astype(np.float32)], int(rnd.integers(0, 2)), "x"))
    for _ in range(40):
        rows.append((len(rows), rows[0][1], 1, "x"))
    one = rows[0][1]
    odd = [(900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] + one[1:], 1), (903, [None] + one[1:], 1), (904, [float("inf")] + one[1:], 1), (905, one, None), (906, one[:4], 1), (907, [2 * x for x in one], 1), (908, [], 1), (909, [1.0] * 3000, 1), (910, [1.0] * 2999 + [0.5], 1), (None, one, 1)]
    rows += [(*r, None) for r in odd]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, kept string")
    assert_embeddings(near_duplicates(df, block=block).collect(), rows)
    assert sum(n for n, _ in brute_embeddings(rows)) > 1000
    assert near_duplicates(df.where("false")).collect() == []


def test_embeddings_of_one_id_are_vectors_of_their_own(spark):
    """Fifty tables, a label each, whose ids repeat with other vectors."""
    from quarry.llm.embed_dedup import near_duplicates

    rows = [(1, [1.0, 0.0, 0.0], 99), (1, [0.0, 1.0, 0.0], 99), (2, [1.0, 0.01, 0.0], 99), (3, [0.01, 1.0, 0.0], 99), (4, [0.0, 1.0, 0.01], 99)]
    rnd = np.random.default_rng(8)
    for table in range(50):
        centres = rnd.normal(size=(3, 5))
        for _ in range(int(rnd.integers(5, 25))):
            v = centres[rnd.integers(0, 3)] + rnd.normal(scale=0.12, size=5)
            rows.append((int(rnd.integers(0, 12)), [float(x) for x in v.astype(np.float32)], table))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    out = near_duplicates(df).collect()
    assert_embeddings(out, rows)
    assert sorted(r.n_links for r in out if r.vec_id == 1)[-1] > 0


def test_embedding_cells_hold_every_pair():
    """Whatever the pivots, linked vectors share a cell where one of them is at home; cells of dense data are few."""
    from quarry.llm import embed_dedup as e

    rnd, tau = np.random.default_rng(5), (2 - 2 * e.COSINE) ** 0.5
    for dim in (3, 16):
        v = rnd.normal(size=(400, dim)) * rnd.choice([1, 3], size=(400, dim))
        v = np.concatenate([v, v + rnd.normal(scale=0.15 / dim**0.5, size=v.shape) * np.linalg.norm(v, axis=1)[:, None]])
        v /= np.linalg.norm(v, axis=1)[:, None]
        linked = np.argwhere(np.triu(v @ v.T >= e.COSINE, 1))
        assert len(linked) > 200
        for number in (1, 2, 7, 40, 200):
            row, cell, home, core = e.cells_of(v, e.choose_pivots(v, number, tau), tau)
            met, at_home = defaultdict(set), {}
            for r, c, h in zip(row.tolist(), cell.tolist(), home.tolist(), strict=True):
                met[r].add(c)
                if h:
                    at_home[r] = c
            assert all(sum((at_home[a] == c or at_home[b] == c) for c in met[a] & met[b]) == 1 for a, b in linked.tolist())
            assert (core <= home).all()
    code, scale, bound = e.one_byte(v)
    assert (np.linalg.norm(v - code * scale[:, None].astype(np.float64), axis=1) <= bound).all()
    tight = rnd.normal(size=(600, 16)).repeat(5, axis=0) + rnd.normal(scale=0.01, size=(3000, 16))
    tight /= np.linalg.norm(tight, axis=1)[:, None]
    spread = rnd.normal(size=(3000, 64))
    spread /= np.linalg.norm(spread, axis=1)[:, None]
    assert len(e.plan_pivots(tight, np.zeros(3000, int), 1e7, tau)) > 100 > len(e.plan_pivots(spread, np.zeros(3000, int), 1e4, tau)) >= e.FEWEST


def test_quality_rules_counts(spark, corpus):
    from quarry.llm.quality_rules import judge, passing_documents

    docs, rows = corpus
    extra = [(7000, "a b c a b c # <x>| é", "en", "s", 1), (7001, "same line\nsame line\n \n \nother", "en", "s", 1), (7002, "x" * 9000, "en", "s", 1)]
    docs = docs.union(spark.createDataFrame(extra, DOCS))

    def expected(text):
        text = text or ""
        w = words_of(text)
        lines, seen, dup = text.split("\n"), set(), 0
        for line in lines:
            if words_of(line):
                dup += line in seen
                seen.add(line)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        many = {x for x, k in Counter(windows).items() if k > 1}
        repeat = len({i + j for i, x in enumerate(windows) if x in many for j in range(3)})
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, repeat, len(w) < 50 or 100 * repeat > 50 * len(w)

    out = judge(docs).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out)
    assert got == Counter((r[0], *expected(r[1])) for r in [*rows, *extra])
    assert not any(r.kept and r.base_failed for r in out)
    kept = passing_documents(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in out if r.kept)
    assert judge(empty(spark)).collect() == []


def test_quality_rules_clashing_columns(spark):
    from quarry.llm.quality_rules import judge, passing_documents

    rows = [(1, "word " * 60, "a", 1), (1, "word " * 60, "a", 1), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, ratio int")
    assert sorted((r.n_words, r.kept) for r in judge(df).collect()) == [(0, False), (60, False), (60, False)]
    assert passing_documents(df).columns == df.columns


def test_quality_bands_reject_both_ends():
    import zstandard

    from quarry.llm.quality_rules import band_verdict, ratios

    rnd, zstd = random.Random(1), zstandard.ZstdCompressor(level=3)
    noise, loop = bytes(rnd.choices(range(33, 127), k=20000)), b"the same words again and again. " * 700
    assert not band_verdict(len(noise), *ratios(noise, zstd))
    assert not band_verdict(len(loop), *ratios(loop, zstd))
    words = b"of in to a by on it is as at or we he be so do if up an us my no go me am ox pi ad hi ho ha oh ye lo ax id em en ma pa "
    for size in (100, 150, 200, 255):  # also where the base rule leaves little room
        assert not band_verdict(size, *ratios(bytes(rnd.choices(range(33, 127), k=size)), zstd)) or size < 110
        assert not band_verdict(size, *ratios((b"a b " * 64)[:size], zstd))
    assert band_verdict(120, *ratios(words[:120], zstd))
    assert not band_verdict(0, *ratios(b"", zstd))


@pytest.mark.parametrize("at", [0, 4096, 20480])
def test_quality_bands_judge_the_remainder(spark, at):
    """The same fault decides wherever it stands, also behind the last full chunk."""
    import base64

    import zstandard

    from quarry.llm.quality_rules import band_verdict, ratios

    rnd, zstd = random.Random(2), zstandard.ZstdCompressor(level=3)
    texts = [t.encode() for t in pd.read_parquet(DATA.replace("sf0.001", "sf0.1") + "/documents.parquet").query("lang == 'en' and n_chars > 20480")["text"]]
    prose = next(t for t in texts if band_verdict(20480, *ratios(t[:20480], zstd)))[:20480]
    for junk in (bytes(rnd.choices(range(33, 127), k=2000)), base64.b64encode(rnd.randbytes(1500)), b"again " * 400):
        text = prose[:at] + junk + prose[at:]
        low, high = ratios(text, zstd)[1:]
        assert not band_verdict(len(text), *ratios(text, zstd)), (at, low, high)
    for size in (4096, 4097, 8191, 20000):
        assert band_verdict(size, *ratios(prose[:size], zstd)), size
    assert ratios(prose[:4000], zstd)[1] != ratios(prose[:4000], zstd)[1]


def test_quality_bands_fit_reference_prose(spark):
    """The limits come from whole sf0.1 without labels; labels show that they decide beyond the base rule."""
    import zstandard

    from quarry.llm.quality_rules import CHUNK, CHUNK_LIMITS, WHOLE, chunk_limits, judge, short_cuts, two_languages, whole_limits

    folder, zstd = DATA.replace("sf0.001", "sf0.1"), zstandard.ZstdCompressor(level=3)
    docs = judge(spark.read.parquet(f"{folder}/documents.parquet")).toPandas().merge(pd.read_parquet(f"{folder}/documents.parquet"), on="doc_id")
    docs["raw"] = [t.encode() for t in docs["text"].fillna("")]
    docs["size"] = docs["raw"].map(len)
    prose = docs[~docs["base_failed"] & (docs["size"] >= 256)]
    once = prose.drop_duplicates("text")
    texts, languages = once["raw"].tolist(), once["lang"].tolist()
    full = [(t[i : i + CHUNK], x) for t, x in zip(texts, languages, strict=True) for i in range(0, len(t) - CHUNK + 1, CHUNK)]
    mixed = [t for t in two_languages(texts, languages) if len(t) >= 256]
    rate = lambda ts: np.array([len(t) / len(zstd.compress(t)) for t in ts])
    fit = lambda ts, xs: whole_limits(np.array([len(t) for t in ts]), rate(ts), np.array(xs))
    one, two = fit(texts, languages), fit(mixed, ["two"] * len(mixed))
    for k in one:
        assert (min(one[k][0], two[k][0]), one[k][1]) == pytest.approx(WHOLE[k], abs=0.01), k
    short = short_cuts(texts)
    lowest = whole_limits(np.array([len(t) for t in short]), rate(short), np.array(languages), range(6, 9))
    assert all(lowest[k] == pytest.approx(WHOLE[k], abs=0.01) for k in (6, 7))
    chunks, own = [t for t, _ in full], [x for _, x in full]
    pairs = two_languages(chunks, own)
    low, high = chunk_limits(rate(chunks), np.array(own))
    assert (min(low, chunk_limits(rate(pairs), np.array(["two"] * len(pairs)))[0]), high) == pytest.approx(CHUNK_LIMITS, abs=0.01)
    labelled = prose.merge(pd.read_parquet(f"{folder}/labels.parquet"), on="doc_id")
    kept = labelled.groupby("quality")["kept"].mean()
    assert kept[1] > 0.998 and kept[0] < 0.4
    # by length: clean ones stay everywhere; bad ones go the more the longer they are
    by = labelled.groupby([labelled["size"].map(lambda n: min(13, int(np.log2(n)))), "quality"])["kept"].mean().unstack()
    assert (by[1] > 0.99).all()
    assert [by[0][k] < most for k, most in ((10, 0.45), (11, 0.3), (12, 0.3), (13, 0.3))] == [True] * 4, by


def test_quality_classifier(spark, corpus):
    from quarry.llm import quality_classifier as qc

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = qc.classify(docs)
    both = out.join(labels, "doc_id").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in both]) > 0.95
    assert np.mean([r.kept for r in both if r.quality == 1]) > 0.97
    rows = qc.classify(corpus[0]).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in corpus[1])
    assert all(r.score == 0 and not r.kept for r in rows if r.n_words == 0)
    assert qc.classify(empty(spark)).collect() == []


def test_label_model_finds_accuracies():
    from quarry.llm import quality_classifier as qc

    rnd, k = np.random.default_rng(2), len(qc.LABELLERS)
    kind = np.array([c for *_, c in qc.LABELLERS])
    truth = rnd.choice(3, size=20000, p=[0.8, 0.12, 0.08])
    hit = np.where(kind[None] == truth[:, None], rnd.random((len(truth), k)) < 0.7, rnd.random((len(truth), k)) < 0.03)
    pattern, counts = np.unique(qc.pattern_of(np.where(hit, qc.BAD, qc.GOOD)), return_counts=True)
    model = qc.estimate(pattern, counts)
    assert abs(model.share[0] - 0.8) < 0.03
    assert all(abs(model.table[j, c, qc.BAD] - (0.7 if kind[j] == c else 0.03)) < 0.06 for j in range(k) for c in (1, 2))


def brute_grams(raw, size, bits):
    """The hashed n-grams of bytes, one at a time."""
    from quarry.llm.byte_features import _FACTORS

    out = []
    for i in range(len(raw) - size + 1):
        code = size * 0x01000193
        for k in range(size):
            code = (code ^ raw[i + k]) * int(_FACTORS[k]) & 0xFFFFFFFF
        code ^= code >> 15
        out.append((code * 0x2C1B3C6D & 0xFFFFFFFF) >> (32 - bits))
    return out


def brute_measures(text):
    """What each labeller measures of a text, from its definition."""
    raw = (text or "").encode()
    w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    lines = [x for line in raw.split(b"\n") if (x := line.rstrip())]
    letters = len(re.findall(rb"[A-Za-z]", raw))
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    again = {i + k for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    seen, copies = set(), 0
    for line in raw.split(b"\n"):
        if line.strip(b" \t\n\x0b\x0c\r"):
            copies += line in seen
            seen.add(line)
    plain = re.compile(rb"[0-9A-Za-z.,;:?)\x22\x27\x00-\x20\x7f-\xff]")
    pairs = [
        (len(re.findall(rb"[#*$%&|<>]", raw)), len(w)), (len(re.findall(rb"[A-Z]", raw)), letters), (raw.count(b"!"), len(w)), (len(again), len(w)),
        (sum(x == y for x, y in zip(w, w[1:], strict=False)), len(w)), (copies, len(lines)), (len(re.findall(rb"[0-9]", raw)), letters),
        (sum(x[-1:] not in b'.!?:;"\x27)' for x in lines), len(lines)), (sum(len(re.findall(rb"[!-@\[-`{-~]", x)) for x in w), sum(map(len, w))), (sum(not plain.fullmatch(x[-1:]) for x in w), len(w)),
    ]
    return [a / b if b else float("nan") for a, b in pairs]


def test_quality_label_model_by_documents(corpus):
    """Measures, votes and the label model against one text and one document at a time, without patterns."""
    from quarry.llm import quality_classifier as qc

    texts = [r[1] for r in corpus[1]] + ["HELLO!!! BUY 123 $$$", "same same same same", "a\na\na\nb.", "# * % é ünï", "x 1 2 3 4 5 6 7"]
    got = np.concatenate(list(qc.measure(pa.array(texts))))
    expected = np.array([brute_measures(t) for t in texts])
    assert np.allclose(got[:, :-1], expected, equal_nan=True)
    vote = np.array([[qc.GOOD if x <= good else qc.BAD if x >= bad else qc.NONE for x, (_, good, bad, _) in zip(row, qc.LABELLERS, strict=True)] for row in expected])
    some = got[:, -1] > 0
    vote = vote[some]
    assert (qc.votes(got)[some] == vote).all()
    pattern, counts = np.unique(qc.pattern_of(vote), return_counts=True)
    model = qc.estimate(pattern, counts)
    kind = [c for *_, c in qc.LABELLERS]
    belief = []
    for v in vote:
        against = [sum(x == qc.BAD and k == c for x, k in zip(v, kind, strict=True)) for c in range(qc.CLASSES)]
        belief.append([0.9 * (a / sum(against) if sum(against) else c == 0) + 0.1 / qc.CLASSES for c, a in enumerate(against)])
    for _ in range(qc.ROUNDS):
        share = [(sum(b[c] for b in belief) + 1) / (len(vote) + qc.CLASSES) for c in range(qc.CLASSES)]
        table = [[[sum(b[c] for b, v in zip(belief, vote, strict=True) if v[j] == x) + 1 for x in range(3)] for c in range(qc.CLASSES)] for j in range(len(kind))]
        table = [[[x / sum(row) for x in row] for row in own] for own in table]
        before, belief = belief, []
        for v in vote:
            mass = [share[c] * np.prod([table[j][c][x] for j, x in enumerate(v)]) for c in range(qc.CLASSES)]
            belief.append([m / sum(mass) for m in mass])
        if max(abs(x - y) for a, b in zip(before, belief, strict=True) for x, y in zip(a, b, strict=True)) < 1e-9:
            break
    assert np.allclose([b[0] for b in belief], model.posterior[qc.pattern_of(vote)], atol=1e-6)
    assert np.allclose(table, model.table, atol=1e-6)


def test_quality_scorer_by_trigrams(spark):
    """Scores of a text from its trigrams, one at a time; ties, repeated rows and clashing columns."""
    from quarry.llm import quality_classifier as qc

    rnd = np.random.default_rng(3)
    weights, texts = rnd.normal(size=1 << qc.BITS), ["plain words here", "Ünï #1", "a", "ab", "the the the the", "x " * 50000]
    posterior = rnd.random(3 ** len(qc.LABELLERS))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    (out,) = qc._judge(posterior, weights, 0.25)(iter([batch]))
    for text, score in zip(texts, out.column("score").to_pylist(), strict=True):
        grams = Counter(brute_grams(text.encode(), 3, qc.BITS))
        raw = sum(n**0.5 * weights[g] for g, n in grams.items()) / sum(grams.values()) ** 0.5 if grams else None
        vote = qc.votes(np.array([brute_measures(text)]))
        assert score == pytest.approx(1 / (1 + np.exp(-(raw + 0.25))) if grams else posterior[qc.pattern_of(vote)[0]], abs=1e-9)
    rows = [(1, "good plain words in a row.", 9), (1, "good plain words in a row.", 9), (None, "good plain words in a row.", 8), (2, None, 1), (3, "#### $$$$ !!!!", 1)] * 4
    df = spark.createDataFrame(rows, "doc_id long, text string, score int").withColumnRenamed("score", "kept").selectExpr("*", "1 AS n_words", "'x' AS weak_label")
    got = qc.classify(df).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert len({r.score for r in got if r.n_words == 6}) == 1 and {r.n_words for r in got if r.doc_id == 2} == {0}


def test_language_scores_by_centroids(spark):
    """Cosines with every centroid, from one n-gram at a time; repeated rows, long texts and clashing columns."""
    from quarry.llm import language_id as li

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = li.fit(docs)
    texts = [r.text for r in docs.where("text is not null").limit(12).collect()] + ["the", "Straße ÜBER", "a1b2 c3!", "und " * 30000]
    got = model.predict(pa.array(texts))
    for text, language, score in zip(texts, got[0], got[1], strict=True):
        raw = bytes(0x20 if b < 128 and not chr(b).isalpha() else b for b in text[:3000].lower().encode()) if len(text) < 3000 else None
        if raw is None:
            continue
        grams = Counter(g for size in (2, 3) for g in brute_grams(raw, size, li.BITS))
        vector = {g: n**0.5 * model.idf[g] for g, n in grams.items()}
        length = sum(x * x for x in vector.values()) ** 0.5
        cosines = [sum(x * c[g] for g, x in vector.items()) / length for c in model.centroids]
        assert score == pytest.approx(max(cosines), abs=1e-9) and language == model.languages[int(np.argmax(cosines))]
    assert got[0][-1] == "de" and 0 < got[1][-1] <= 1
    odd = spark.createDataFrame([(i % 3, t, "xx", 1.0, "en") for i, t in enumerate(texts * 2)], "doc_id long, text string, lang_pred string, score double, held_out string").selectExpr("*", "cast(null as string) AS lang")
    out = li.identify(odd, model).collect()
    assert Counter((r.lang_pred, round(r.score, 9)) for r in out) == Counter((a, round(float(b), 9)) for a, b in zip(got[0] * 2, np.tile(got[1], 2), strict=True))
    tie = li.Model(model.idf, np.concatenate([model.centroids, model.centroids]), [*model.languages, *["zz"] * len(model.languages)], np.tile(model.limits, 2))
    assert tie.predict(pa.array(texts))[0] == got[0]
    assert li.accepted_documents(odd, model).columns == odd.columns


def test_language_id(spark, corpus):
    from quarry.llm import language_id

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert np.mean([r.lang == r.lang_pred for r in out if r.held_out]) > 0.97
    assert all(0 <= r.score <= 1 for r in out)
    assert np.mean([r.rejected for r in out]) < 0.01
    changed = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(cast(doc_id as string)) % 5 <> 0 THEN lang END AS lang")
    assert sorted((r.doc_id, r.lang_pred, r.score) for r in language_id.identify(changed).collect()) == sorted((r.doc_id, r.lang_pred, r.score) for r in out)
    model = language_id.fit(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (None, "the and of that"), (5, "ц" * 400), (6, "qqqq zzxx " * 300)], "doc_id long, text string").selectExpr("*", "cast(null as string) AS lang")
    got = {r.doc_id: r for r in language_id.identify(odd, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (1, 2, 3))
    assert got[None].lang_pred == "en" and not got[None].held_out and not got[None].rejected
    assert got[5].rejected and got[6].rejected
    assert sorted(r.doc_id for r in language_id.accepted_documents(odd.where("doc_id is not null"), model).collect()) == []
    assert {r.lang_pred for r in language_id.identify(odd).collect()} == {"und"}
    assert language_id.identify(empty(spark)).collect() == []


def test_url_filter_rules_and_twin(spark):
    from quarry.llm import queries, url_filter

    urls = [None, "", "no scheme", "http://", "http://A.COM/x", "https://com/", "http://com", "http://xcom/y", "http://example.com/en/1?q", "http://www.example.com/en/1#f", "ftp://b.example.com/en", "http://z.net/es/1", "http://net/fr/", "http://a.org/ünï/1", "http://a.org/x?y=http://b.com/", "http://q.net/" + "a/" * 3000]
    pages = [(i, u) for i, u in enumerate(urls)] + [(None, "http://a.com/"), (1, "")]
    pages += [(90, "http://a.com/" + "ab0" * 20000), (91, "no scheme " * 5000)]
    pages += [(100 + i, f"http://host{i % 7}.example.{('com', 'net', 'org')[i % 3]}/{('en', 'es', 'fr', 'de')[i % 4]}/{i}") for i in range(400)]
    df = spark.createDataFrame(pages, "page_id long, url string").repartition(3)
    clashing = df.selectExpr("*", "1 AS host", "'x' AS verdict", "array(1) AS form")
    assert Counter(url_filter.judge_urls(clashing).collect()) == Counter(url_filter.judge_urls(df).collect())
    out = url_filter.judge_urls(df).select("page_id", "host", "path", "rule", "verdict").toPandas()
    assert len(out) == len(pages)
    got = {r.page_id: r for r in out.itertuples() if r.page_id == r.page_id}
    assert [got[i].rule if isinstance(got[i].rule, str) else None for i in range(13)] == [None, None, None, None, "com/", "com/", None, None, "example.com/en/", "www.example.com/en/", "com/", "net/es/", "net/fr/"]
    assert got[4].host == "a.com" and got[4].path == "/x" and got[14].path == "/x" and got[0].host == "" and got[0].verdict == "block"
    other = twin(queries.oracle_sql()["op3_url_filters"], pages=df.toPandas())
    key = lambda d: sorted(map(str, d[["page_id", "host", "path", "rule", "verdict"]].astype(object).where(d.notna(), None).values.tolist()))
    assert key(out) == key(other)
    assert url_filter.judge_urls(df.where("false")).collect() == []
    assert {r.verdict for r in url_filter.judge_urls(spark.createDataFrame([(1, "http://a.org/b")], "page_id long, url string")).collect()} == {"allow"}


def token_file_rows(spark, docs, rows, path):
    """The rows that files of docs give, after they were held against the library: order, places, ids and checksums."""
    from tokenizers import Tokenizer

    from quarry.llm import token_files
    from quarry.llm.storage import fresh_path

    folder, tokenizer, start = fresh_path(spark, "tokens"), Tokenizer.from_file(path), 0
    manifest = token_files.write_tokens(docs, folder, path)
    out = sorted(token_files.read_tokens(spark, folder, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    for r in out:
        assert r.start == start and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    assert manifest["n_tokens"] == start
    encoded = dict(zip((texts := sorted({r[1] or "" for r in rows})), tokenizer.encode_batch(texts, add_special_tokens=False), strict=True))
    assert Counter((r.doc_id, tuple(r.ids)) for r in out) == Counter((r[0], (*encoded[r[1] or ""].ids, 0)) for r in rows)
    return manifest


def test_token_files(spark, corpus, monkeypatch):
    import public_tokenizers

    from quarry.llm import token_files
    from quarry.llm.storage import fresh_path

    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(token_files, "READ_TOKENS", 3000)
    token_file_rows(spark, *corpus, path)
    clashing = [(i % 7 if i % 3 else None, f"row {i % 5}" if i % 4 else None, "x", i) for i in range(300)]
    token_file_rows(spark, spark.createDataFrame(clashing, "doc_id long, text string, start string, ids int").repartition(3), clashing, path)
    folder = fresh_path(spark, "tokens")
    assert token_files.write_tokens(empty(spark), folder, path)["parts"] == []
    assert token_files.read_tokens(spark, folder).collect() == []


@pytest.mark.parametrize("doc", [None, 5])
def test_token_files_split_one_id(spark, doc):
    """A group of equal rows does not meet in one part."""
    import public_tokenizers

    rows = [(doc, "the same text", None, None, None)] * 3000 + [(i, f"other {i}", None, None, None) for i in range(300)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = token_file_rows(spark, spark.createDataFrame(rows, DOCS).repartition(8), rows, public_tokenizers.path("byte_bpe_50k.json"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(manifest["parts"]) > 1 and max(p["n_docs"] for p in manifest["parts"]) < 2000


def test_token_ids_equal_the_library():
    """Cuts are pre-token borders whatever white space, signs, quotes and scripts meet; also where a worker forgets."""
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    from quarry.llm import token_files

    spec = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    rnd, tokenizer = random.Random(12), Tokenizer.from_str(spec)
    texts = ["", "a", " a", "a  b", "x\ny z", "don't 's it's a1 b' Tür, Straße!? é; x.y ,; ab1,", "a\n", "tab\tb c", "q \x1c u\u00a0 v\u2028w", "a \n <|endoftext|> a <|endoftext|>", "漢字 ж, 🙂. a", "e\u0301 ’s “a”"]
    texts += ["".join(rnd.choices("abcde  \n\t.,'sttÄé×÷ªЖ漢🙂0129\x0b\x0c\r\x1c\x85\u00a0\u2009\u3000-_<>“”’", k=rnd.randint(1, 40))) for _ in range(3000)]
    texts += ["".join(rnd.choices(["ab", "à", "s", "t", "ll", " ", "  ", "\n", " \n", "\t", "é", ".", ",'", "'", "'s", "12", "×", "’", "“"], k=rnd.randint(1, 14))) for _ in range(5000)]
    rnd.shuffle(texts)
    expected = [[*e.ids, 0] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for limit in (600_000, 100):
        encoder = token_files.TextEncoder(spec, "<u2", 0)
        assert encoder.joins and encoder.bytewise
        encoder.known.limit = limit
        for lo in [*range(0, len(texts), 1000), 0]:
            tokens, sizes = encoder.encode(pa.array(texts[lo : lo + 1000]))
            assert [x.tolist() for x in np.split(tokens, np.cumsum(sizes)[:-1])] == expected[lo : lo + 1000]
    # a tokenizer that merges across spaces is given whole texts
    across = json.loads(spec) | {"pre_tokenizer": {"type": "Metaspace", "replacement": "▁", "prepend_scheme": "never", "split": False}, "added_tokens": []}
    across["model"] |= {"vocab": {"a": 0, "▁": 1, "b": 2, "a▁": 3, "a▁b": 4}, "merges": [["a", "▁"], ["a▁", "b"]]}
    across = json.dumps(across)
    tokens, sizes = token_files.TextEncoder(across, "<u2", 9).encode(pa.array(["a b a b", "b"]))
    assert tokens.tolist() == [*Tokenizer.from_str(across).encode("a b a b").ids, 9, 2, 9] and 4 in tokens.tolist()


ODD_TEXTS = ["", " ", "   ", "a  b", "  lead", "trail  ", "tab\tnew\n\nline", " \n \n", "ÄÖ ß 漢字 🙂 ​", "▁mark ▁▁x", "0123456789", "\x00\x7f", "é", "aaaa" * 50, "漢" * 3000, "x" * 70000]


def odd_texts(seed, number=400):
    rnd = random.Random(seed)
    return ODD_TEXTS + ["".join(rnd.choices("abcde  \n.,ÄéЖ漢🙂▁0", k=rnd.randint(1, 60))) for _ in range(number)]


@pytest.mark.parametrize("remembered", [600_000, 50])
def test_sentencepiece_equals_the_library(spark, corpus, monkeypatch, remembered):
    from sentencepiece import SentencePieceProcessor

    from quarry.llm import sp_fst
    from quarry.llm.queries import tokenizer_file

    path = tokenizer_file("piece_bpe_32k.model")
    sp = SentencePieceProcessor(model_file=path)
    texts = [r[1] for r in corpus[1]] + odd_texts(4)
    monkeypatch.setattr(sp_fst, "REMEMBERED", remembered)
    monkeypatch.setattr(sp_fst, "BLOCK", 5000)
    t = sp_fst.Transducer(sp_fst.read_model(path))
    for lo in range(0, len(texts), 100):
        some = texts[lo : lo + 100]
        normal = t.normal(pa.array(some))
        ids, counts = t.encode(normal)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [sp.encode(x or "") for x in some]
        assert t.decode(ids, counts).to_pylist() == [(x or "").replace("▁", " ") for x in some]


def test_sentencepiece_rows(spark, corpus):
    """Null and repeated ids, clashing columns, and ids that are no text."""
    from sentencepiece import SentencePieceProcessor

    from quarry.llm import sp_fst
    from quarry.llm.queries import tokenizer_file

    path = tokenizer_file("piece_bpe_32k.model")
    sp = SentencePieceProcessor(model_file=path)
    rows = [(i, t, 1, "x") for i, t in enumerate(odd_texts(5, 20))] + [(None, "no id", 1, None), (None, None, None, None), (3, "again", 1, None), (3, "again", 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string").repartition(3)
    encoded = sp_fst.encode_documents(df, path)
    out = encoded.collect()
    key = lambda i, t: (i, tuple(sp.encode(t or "")), (t or "").replace("▁", " "))
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in out) == Counter(key(i, t) for i, t, *_ in rows)
    assert all(r.n_tokens == len(r.ids) and r.round_trip and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in out)
    back = sp_fst.decode_documents(encoded, path).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((r.doc_id, r.decoded) for r in out)
    strange = spark.createDataFrame([(1, None), (2, []), (3, [1, 2, 0]), (4, [sp.piece_to_id("<0xC3>")]), (5, sp.encode("plain"))], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in sp_fst.decode_documents(strange, path).collect()} == {1: "", 2: "", 3: "⁇ ", 4: "�", 5: "plain"}
    assert sp_fst.encode_documents(df.where("false"), path).collect() == []


def _varint(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number, value):
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.float32(value).tobytes()
    return _varint(number << 3) + _varint(value)


def unigram_model(pieces, fallback=1):
    """A serialised unigram model, from given pieces and scores."""
    listed = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256 * fallback)] + [(p, w, 1) for p, w in pieces.items()]
    parts = [_field(1, _field(1, p.encode()) + _field(2, w) + _field(3, k)) for p, w, k in listed]
    return b"".join([*parts, _field(2, _field(3, 1) + _field(35, fallback)), _field(3, _field(1, b"identity") + _field(3, 1) + _field(4, 0) + _field(5, 1))])


def test_sentencepiece_unigram_by_least_weight():
    """Without a constraint the tropical weights alone decide, as in the library and by trying all paths."""
    from sentencepiece import SentencePieceProcessor

    from quarry.llm import sp_fst

    rnd = random.Random(6)
    pieces = {c: -6 - rnd.random() for c in "▁abcdeÄé."}
    while len(pieces) < 160:
        pieces[rnd.choice(["", "▁"]) + "".join(rnd.choices("abcdeÄé", k=rnd.randint(1, 5)))] = -3 - 9 * rnd.random()
    model = unigram_model(pieces)
    sp, t = SentencePieceProcessor(model_proto=model), sp_fst.Transducer(model)
    assert not t.merging
    texts = odd_texts(7, 300) + ["".join(rnd.choices("abcdeÄé ", k=12)) for _ in range(300)]
    normal = t.normal(pa.array(texts))
    ids, counts = t.encode(normal)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [sp.encode(x) for x in texts]
    assert t.decode(ids, counts).to_pylist() == normal.to_pylist()

    @functools.cache
    def least(rest):
        return min((-pieces[rest[:k]] + least(rest[k:]) for k in range(1, len(rest) + 1) if rest[:k] in pieces), default=0.0 if not rest else float("inf"))

    for text in ["".join(rnd.choices("abcdeÄé ", k=9)) for _ in range(100)]:
        ids, _ = t.encode(pa.array([text]))
        assert sum(t.weight[ids]) == pytest.approx(least("▁" + text.replace(" ", "▁")), abs=1e-4)


def test_sentencepiece_constraint_is_what_merging_leaves():
    from quarry.llm import sp_fst
    from quarry.llm.queries import tokenizer_file

    t, rnd = sp_fst.Transducer(sp_fst.read_model(tokenizer_file("piece_bpe_32k.model"))), random.Random(3)

    def merged(text):
        parts = list(text)
        while True:
            weights = [(t.arcs.get(a + b, (0, float("inf")))[1], i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            if not weights or min(weights)[0] == float("inf"):
                return parts
            at = min(weights)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    common = [p for p in list(t.arcs)[:4000] if p.strip("▁").isalpha()]
    pairs = [(rnd.choice(common), rnd.choice(common)) for _ in range(3000)]
    got = [t.adjacent(t.arcs[a][0], t.arcs[b][0]) for a, b in pairs]
    assert got == [merged(a + b) == [a, b] for a, b in pairs]
    assert 0.05 < np.mean(got) < 0.95
    with pytest.raises(ValueError):
        sp_fst.Transducer(unigram_model({"a": -1.0}, fallback=0))


def test_sentencepiece_query_returns_ids_and_texts(spark):
    from quarry.llm import queries

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in queries.op7_sentencepiece(spark, DATA).collect():
        assert len(r.ids) == r.n_tokens and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert r.decoded == texts[r.doc_id]


def test_sharding_twin_and_stability(spark, corpus):
    from quarry.llm import queries, sharding

    docs, rows = corpus
    out = sharding.shard_documents(docs).select("doc_id", "slot", "shard").toPandas()
    other = twin(queries.oracle_sql()["op8_sharding"], documents=docs.toPandas().astype({"doc_id": "Int64"}))
    key = lambda d: Counter((None if pd.isna(i) else int(i), int(a), int(b)) for i, a, b in d[["doc_id", "slot", "shard"]].values.tolist())
    assert key(out) == key(other) and len(out) == len(rows)
    names = [f"shard-{i:05d}" for i in range(64)]
    before, after = sharding.lookup_table(names), sharding.lookup_table(names[:-1])
    assert max(Counter(before).values()) - min(Counter(before).values()) <= 1
    assert np.mean([a != b for a, b in zip(before, after, strict=True) if a != 63]) < 0.1
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 8190)
    with pytest.raises(ValueError):
        sharding.shard_documents(docs.withColumnRenamed("lang", "SLOT"))
    assert sharding.shard_documents(empty(spark)).collect() == []


def test_shards_are_written_by_bytes(spark, corpus, tmp_path):
    """Every row comes back from its shard's folder; a shard beyond the size is several files."""
    from quarry.llm import sharding

    docs, rows = corpus
    sharding.write_shards(docs, f"file://{tmp_path}/a", shards=4, file_bytes=20_000)
    back = spark.read.parquet(f"file://{tmp_path}/a").collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((r[0], r[1]) for r in rows)
    placed = Counter((r.doc_id, r.text, r.shard) for r in sharding.shard_documents(docs, 4).collect())
    assert Counter((r.doc_id, r.text, r.shard) for r in back) == placed
    files = Counter(p.parent.name for p in tmp_path.glob("a/*/*.parquet"))
    assert len(files) == 4 and all(n > 1 for n in files.values())
    sharding.write_shards(docs, f"file://{tmp_path}/b", shards=4)
    assert all(n == 1 for n in Counter(p.parent.name for p in tmp_path.glob("b/*/*.parquet")).values())


def test_mixing_targets_of_many_sources(spark):
    """Places and levels over all tasks equal water-filling in one list."""
    from quarry.llm import mixing

    rnd = random.Random(13)
    sizes = {f"s{i}é"[: rnd.randint(2, 5)] + str(i): int(rnd.paretovariate(0.6) * 10) for i in range(300)} | {None: 70, "": 0, "Z": 3}
    out = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(9)).collect()}
    order = sorted(sizes, key=lambda x: (x is None, (x or "").encode()))
    weight = {x: mixing.WEIGHTS[i % 3] for i, x in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        level = (total - sum(2 * sizes[x] for x in full)) / sum(weight[x] for x in order if x not in full)
        more = {x for x in order if level * weight[x] > 2 * sizes[x]}
        if more == full:
            break
        full = more
    assert 0 < len(full) < len(order)
    for x in order:
        assert out[x] == pytest.approx(2 * sizes[x] if x in full else level * weight[x])
    assert sum(out.values()) == pytest.approx(total)
    assert mixing.source_targets(spark.createDataFrame([("a", 0), ("b", 0)], "source string, source_size long")).collect() == [("a", 0, 0.0), ("b", 0, 0.0)]


def test_mixing_twin_and_targets(spark, corpus):
    from quarry.llm import mixing

    docs, rows = corpus
    out = mixing.mix(docs).toPandas()
    again = mixing.mix(docs.repartition(3)).toPandas()
    key = lambda d: Counter(map(str, d[["doc_id", "source", "size", "source_size", "copies", "taken"]].values.tolist()))
    assert key(out) == key(again) and len(out) == len(rows)
    assert (out["taken"] <= 2 * out["size"]).all()
    assert (out["size"] == out["taken"]).any()
    for _, own in out.groupby("source", dropna=False):
        assert abs(own["taken"].sum() - own["target"].iloc[0]) <= own["size"].max()
    mixed = mixing.mixed_documents(docs.withColumnRenamed("n_chars", "copies"))
    assert mixed.columns == ["doc_id", "text", "lang", "source", "copies"]
    assert mixed.count() == out[out["size"] > 0]["copies"].sum()
    assert mixing.mix(empty(spark)).collect() == []


@pytest.mark.parametrize("doc", [None, 7])
def test_mixing_cuts_among_repeated_rows(spark, doc):
    """A source of equal rows meets its target to a row, as the SQL twin does."""
    from quarry.llm import mixing
    from quarry.llm.queries import MIXING_SQL

    rows = [(doc, "the same ten words in all rows of this group", "en", "s1", 1)] * 300
    rows += [(doc, "three more words", "en", None, 1)] * 40 + [(1000 + i, f"a b c {i} " * (i % 9 + 1), "en", "s2", 1) for i in range(90)]
    docs = spark.createDataFrame(rows, DOCS).repartition(7)
    out = mixing.mix(docs).toPandas()
    assert len(out) == len(rows)
    for _, own in out.groupby("source", dropna=False):
        assert abs(own["taken"].sum() - own["target"].iloc[0]) <= own["size"].max()
    other = twin(MIXING_SQL, documents=pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64"}))
    key = lambda d: Counter(zip(d["source"].fillna("-"), d["size"], d["copies"], strict=True))
    assert key(out) == key(other)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == out["copies"].sum()


@pytest.mark.parametrize("name", ["op3_url_filters", "op8_sharding", "op9_mixing"])
def test_twins_on_given_tables(spark, name):
    from quarry.llm import queries

    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    mine, other = queries.queries()[name](spark, DATA).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(other.columns)
    key = lambda d: sorted(map(str, d[columns].round(6).astype(object).where(d[columns].notna(), None).values.tolist()))
    assert key(mine) == key(other)


def test_graph_components(spark):
    from quarry.llm.graph import connected_components

    rnd = random.Random(9)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(rnd.randint(200, 400), rnd.randint(200, 400)) for _ in range(120)]
    root = components({x for e in edges for x in e}, edges)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if k != v}
