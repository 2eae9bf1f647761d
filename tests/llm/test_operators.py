"""Each operator against a plain restatement of its contract, on small hand-made tables."""

import re
import zlib
from collections import Counter, defaultdict
from math import exp, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecgrove.llm import decontaminate_fm, line_templates, lm_backoff, mix_poisson, near_copies, quality_fertility, simhash_vptree, sstable, token_output, toxicity_segments, url_filter, warc_revisit
from vecgrove.llm.components import components, least_labels
from vecgrove.llm.fm_index import FMIndex, suffix_array

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, kept boolean"


def docs_of(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, f"s{(i or 0) % 2}", len(t or ""), "clash", True) for i, t in texts], DOCS)


def words(n, seed=0, vocabulary=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}q" for x in rng.integers(0, vocabulary, n))


ODD = [None, "", " \n\t ", "one", "A\u00a0b É\u0301 \U0001f600 日本", "x" * 5000, "a b c d " * 3000, "line\n\nline\r\nline"]


@pytest.fixture(scope="module")
def corpus(spark):
    texts = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, words(60 + i, i)) for i in range(12)] + [(112, words(60, 0)), (113, words(60, 0)), (113, words(60, 0)), (None, "null id " + words(30, 5))]
    return docs_of(spark, texts).cache()


def plain(df):
    return [r.asDict() for r in df.collect()]


def by_row(df, columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


# 1


def backoff_by_hand(texts, order=2, least=2, penalty=0.4):
    tokens = [re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    count = Counter(tuple(x[i : i + n]) for x in tokens for n in range(1, order + 1) for i in range(len(x) - n + 1))
    total = sum(map(len, tokens))

    def one(x, i, n):
        if n == 1:
            c = count[(x[i],)]
            return log((c if c >= least else 0.5) / total)
        if i < n - 1:
            return one(x, i, n - 1)
        c = count[tuple(x[i - n + 1 : i + 1])]
        return log(c / count[tuple(x[i - n + 1 : i])]) if c >= least else log(penalty) + one(x, i, n - 1)

    return [(len(x), sum(count[(w,)] < least for w in x), sum(one(x, i, order) for i in range(len(x))) if x else None) for x in tokens]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_backoff(spark, corpus, order):
    texts = [r["text"] for r in corpus.collect()]
    expected = Counter((n, oov, None if s is None else round(s, 5)) for n, oov, s in backoff_by_hand(texts, order))
    small = lm_backoff.Settings(order=order, chunk_bytes=4000, range_keys=500)
    got = lm_backoff.score(corpus, settings=small)
    assert Counter((r["n_words"], r["n_oov"], None if r["log_score"] is None else round(r["log_score"], 5)) for r in got.collect()) == expected
    assert lm_backoff.score(corpus.limit(0)).count() == 0


# 2


def quality_by_hand(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0d]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    n = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    hit = {j for i in range(len(ws) - 7) if n[tuple(ws[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), len(ws) < 20 or 100 * len(hit) > 30 * len(ws)


def test_quality_base(spark, corpus):
    got = quality_fertility.quality(corpus)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert by_row(got, columns) == Counter((r["doc_id"], *quality_by_hand(r["text"])) for r in corpus.collect())
    assert not got.filter("base_failed and kept").count()
    assert quality_fertility.quality(corpus.limit(0)).count() == 0


def test_quality_measures_and_bands(spark):
    import public_tokenizers
    import sentencepiece

    clean = [(i, words(80, i)) for i in range(80)]
    junk = [(100, "".join(f"{w}*** $$$ " for w in words(60, 99).split())), (101, " ".join(["\U00013000\U00013001"] * 9 + [chr(0x13000 + i % 10) for i in range(40)]))]
    df = docs_of(spark, clean + junk)
    got = {r["doc_id"]: r for r in quality_fertility.quality(df).collect()}
    assert all(got[i]["kept"] for i, _ in clean) and not got[100]["kept"] and not got[101]["kept"]
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for i, t in clean[:5] + junk:
        ids = [x for w in t.split() for x in model.encode(w)]
        p = np.array(list(Counter(ids).values())) / len(ids)
        r = got[i]
        assert r["n_tokens"] == len(ids) and abs(r["byte_share"] - np.mean([model.is_byte(x) for x in ids])) < 1e-12
        assert abs(r["entropy"] + (p * np.log2(p)).sum()) < 1e-9 and abs(r["chars_per_token"] - sum(map(len, t.split())) / len(ids)) < 1e-12
    kept = quality_fertility.keep_good(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}


def test_quality_of_rare_languages(spark):
    main = [(i, words(80, i), "en") for i in range(120)]
    # Rare languages of another fertility, and a language's only very short and very long texts.
    rare = [(200 + i, " ".join(f"übermäßigkeit{x}ß" for x in np.random.default_rng(i).integers(0, 400, 80)), "de") for i in range(9)]
    rare += [(300 + i, " ".join(chr(0x1200 + x) + chr(0x1210 + x) for x in np.random.default_rng(i).integers(0, 90, 80)), None) for i in range(3)]
    sizes = [(400, words(22, 7), "en"), (401, words(6000, 8, 4000), "en")]
    junk = [(500, " ".join("abcd"[(i * i) % 4] for i in range(40)) + " x", "fr"), (501, "".join(f"{w}*** $$$ " for w in words(300, 99).split()), "en")]
    df = spark.createDataFrame([(i, t, lang, "s", len(t), "clash", True) for i, t, lang in main + rare + sizes + junk], DOCS)
    kept = {r["doc_id"] for r in quality_fertility.keep_good(df).collect()}
    assert kept == {i for i, _, _ in main + rare + sizes}


def kept_by_hand(rows, b):
    """The bands, restated over measures: ``rows`` have a lang, and the columns of quality()."""
    names = ("chars_per_token", "second_chars_per_token", "entropy", "byte_share", "evenness", "n_tokens")
    for r in rows:
        r["evenness"] = r["entropy"] / np.log2(max(r["n_tokens"], 2))
        r["group"] = ("lang", r["lang"]) if r["lang"] is not None else ("script", r["script"])
        r["class"] = (r["group"], int(np.log2(max(r["n_tokens"], 1))))

    def centres(key):
        found = defaultdict(list)
        for r in rows:
            if not r["base_failed"]:
                found[r[key]].append(r)
        out = {}
        for k, own in found.items():
            q = {c: [sorted(r[c] for r in own)[max(0, int(np.ceil(p * len(own))) - 1)] for p in (0.25, 0.5, 0.75)] for c in names}
            out[k] = len(own), {c: v[1] for c, v in q.items()}, {c: (v[2] - v[0]) / 1.349 for c, v in q.items()}
        return out

    classes, groups, out = centres("class"), centres("group"), []
    for r in rows:
        n, m, s = classes.get(r["class"], (0, dict.fromkeys(names, 0), dict.fromkeys(names, 0)))
        if r["base_failed"] or r["group"] not in groups:
            out.append(False)
            continue
        of, mg, sg = groups[r["group"]]
        lean, wide, size = b.prior / (n + b.prior), 1 + (b.prior / of) ** 0.5, max(r["n_tokens"], 1)
        mid, spread = ({c: x[c] * lean + y[c] * (1 - lean) for c in names} for x, y in ((mg, m), (sg, s)))
        stray = wide * (1 + lean * (max(1, (mg["n_tokens"] / size) ** 0.5) - 1))
        away = wide * (1 + lean * abs(np.log2(size / mg["n_tokens"])))
        half = {c: stray * max(b.spread * spread[c], b.least_ratio * mid[c]) for c in names}
        least_even = mg["evenness"] * b.least_bits / mg["entropy"]
        even = mg["evenness"] - r["evenness"] <= lean * wide * max(b.spread * sg["evenness"], least_even) - (1 - lean)
        bits = mid["entropy"] - r["entropy"] <= away * max(b.spread * spread["entropy"], b.least_bits)
        near = abs(r["chars_per_token"] - mid["chars_per_token"]) <= half["chars_per_token"] and mid["second_chars_per_token"] - r["second_chars_per_token"] <= half["second_chars_per_token"]
        out.append(bool(near and (even or bits) and r["byte_share"] <= mid["byte_share"] + wide * b.most_bytes and r["entropy"] >= b.floor_bits))
    return out


def test_quality_bands_restated(spark):
    rng, rows = np.random.default_rng(9), []
    for i in range(400):
        lang = ("en", "en", "en", "de", None)[i % 5]
        text = words(int(rng.integers(15, 400)), i, int(rng.integers(40, 900)))
        if i % 17 == 0:
            text = "".join(f"{w}{'*$#'[i % 3] * int(rng.integers(1, 4))} " for w in text.split())
        if i % 23 == 0:
            text = " ".join(chr(int(x)) for x in rng.integers(0x400, 0x3000, 120))
        rows.append((i, text, lang, "s", len(text), "clash", True))
    got = [r.asDict() | {"lang": rows[r["doc_id"]][2]} for r in quality_fertility.quality(spark.createDataFrame(rows, DOCS)).collect()]
    want = kept_by_hand(got, quality_fertility.Bands())
    assert [r["kept"] for r in got] == want and 200 < sum(want) < 390


# 3


def test_poisson(spark):
    texts = [(i, f"text {i} " + "x" * (i % 50)) for i in range(3000)]
    df = spark.createDataFrame([(i, t, "en", "hot" if i % 3 else "cold", 1, "clash", True) for i, t in texts] + [(None, None, None, None, None, None, None)], DOCS)
    settings = mix_poisson.Settings(weights={"hot": 1.0, "cold": 2.0}, default_weight=0.5)
    per = {r["mix_source"]: r for r in mix_poisson.rates(df, settings=settings).collect()}
    total = sum(r["chars"] for r in per.values())
    assert abs(per["cold"]["rate"] - total * 2 / 3.5 / per["cold"]["chars"]) < 1e-12
    copies = mix_poisson.replicate(df, settings=settings)
    n = Counter(r["source"] for r in copies.select("row.source").collect())
    for s, size in (("hot", 2000), ("cold", 1000)):
        mean = per[s]["rate"] * size
        assert abs(n[s] - mean) < 5 * mean**0.5
    assert mix_poisson.mixture(df).columns == df.columns and mix_poisson.mixture(df.limit(0)).count() == 0
    first = [tuple(r) for r in copies.select("row.doc_id", "mix_copy").collect()]
    assert Counter(first) == Counter(tuple(r) for r in mix_poisson.replicate(df.repartition(3), settings=settings).select("row.doc_id", "mix_copy").collect())
    u = spark.range(1).select(*[mix_poisson.poisson(F.lit(x), F.lit(1.5), 40).alias(f"k{i}") for i, x in enumerate((0.0, 0.2, 0.3, 0.6, 0.999))]).first()
    cdf = np.cumsum([exp(-1.5) * 1.5**k / np.prod(np.arange(1, k + 1)) for k in range(10)])
    assert list(u) == [int((cdf <= x).sum()) for x in (0.0, 0.2, 0.3, 0.6, 0.999)]


def test_mixing_stage_reaches_targets(spark):
    import corpus_pipeline

    # Sources of 1, 10 and 2000 texts of equal length: the small ones need rates far beyond 4.
    texts = [(i, f"{i:04d}" * 5, "tiny" if i < 1 else "small" if i < 11 else "large") for i in range(2011)]
    df = spark.createDataFrame([(i, t, "en", s, 20, "clash", True) for i, t, s in texts], DOCS)
    n = Counter(r["source"] for r in dict(corpus_pipeline.STAGES)["mixing"](spark, df, "").select("source").collect())
    for s in ("tiny", "small", "large"):
        assert abs(n[s] - 2011 / 3) < 5 * (2011 / 3) ** 0.5
    per = {r["mix_source"]: r for r in mix_poisson.rates(df, settings=mix_poisson.Settings(most_rate=4.0)).collect()}
    assert abs(per["small"]["asked"] - 1 / 3) < 1e-9 and abs(per["small"]["reached"] - 40 / 2011) < 1e-9
    assert all(abs(r["reached"] - r["asked"]) < 1e-9 for r in mix_poisson.rates(df).collect())


# 4


def url_by_hand(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(h, p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, None if best is None else best[0] + best[1], None if best is None else best[2]


URLS = [
    None, "", "nothing", "http://", "http://Example.NET/en/1?x=/", "http://a.example.net/en", "https://www.example.com/de/x#y", "http://net", "http://net/", "http://xnet/", "http://a.org/fr/2", "http://a.org?fr/",
    "ftp://x://y/z", "http://free-bets.example.com/en/1", "http://museum.example.com/en/1", "http://ÄÖ.com/ü", "http://m.casino.example.org/de/3.html",
]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "h", "clash") for i, u in enumerate(URLS)] + [(3, "http://", "h", "x"), (None, None, None, None)], "page_id long, url string, html string, rule string")
    got = url_filter.judge(pages).cache()
    for r in got.collect():
        url = None if r["page_id"] is None else URLS[r["page_id"]]
        host, path, rule, verdict = url_by_hand(url)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["score"] >= 0.5 else "allow"))
    scores = {r["page_id"]: r["score"] for r in got.collect()}
    assert scores[13] > 0.5 > scores[14] and got.count() == len(URLS) + 2
    assert url_filter.judge(pages.limit(0)).count() == 0


def grams_by_hand(text):
    marked = "^" + re.sub("[0-9]+", "0", text) + "$"
    return [marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)]


def test_url_grams_and_training(spark):
    import xxhash

    settings = url_filter.Settings(rounds=3)
    urls = [("http://m.casino9.example.com/en/1", 1), ("http://library.org/x12y", 0), ("https://poker.net/", 1), (None, 0), ("no", 0), ("http://library.org/x12y", 0), ("http://odd", None)]
    known = spark.createDataFrame(urls, "url string, label int")
    host, path = url_filter.parts(F.col("url"))
    # The hash of a seed and a string: the seed's hash is the string's.
    bucket = lambda g, seed: xxhash.xxh64_intdigest(g.encode(), xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), 42)) % 2**64
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    wanted = []
    for u, _ in urls:
        h, p, *_ = url_by_hand(u)
        wanted.append([[signed(bucket(g, seed)) % settings.buckets for g in grams_by_hand(t)] for t, seed in ((h, 1), (p, 2))])
    got = known.select(*url_filter.both_grams(host, path, settings)).collect()
    assert [[list(r["of_host"]), list(r["of_path"])] for r in got] == wanted
    # Training, restated with arrays.
    order = sorted((r["k"], i) for i, r in enumerate(known.select(F.xxhash64("url", "label").alias("k")).collect()) if urls[i][1] is not None)
    w, g2, b = np.zeros(settings.buckets), np.full(settings.buckets, 1e-6), 0.0
    for _ in range(3):
        for _, i in order:
            x = [(np.array(g), len(g) ** -0.5) for g in wanted[i] if g]
            z = b + sum(s * w[g].sum() for g, s in x)
            e = (1 / (1 + exp(-z)) - urls[i][1]) * {1: 6 / 4, 0: 6 / 8}[urls[i][1]]
            b -= settings.rate * 0.1 * e
            for g, s in x:
                for k in g:
                    d = e * s + settings.ridge * w[k]
                    g2[k] += d * d
                    w[k] -= settings.rate * d / np.sqrt(g2[k])
    weights, base = url_filter.train(known, settings)
    assert np.allclose(weights, w) and abs(base - b) < 1e-9
    with pytest.raises(ValueError):
        url_filter.train(known, url_filter.Settings(most_labels=2))


def test_url_names_held_out(spark):
    names = url_filter.names()
    model = url_filter.train(url_filter.labelled_urls(spark, [x for i, x in enumerate(names) if i % 5 != 2]))
    host, path = url_filter.parts(F.col("url"))
    held = url_filter.labelled_urls(spark, [x for i, x in enumerate(names) if i % 5 == 2]).select("label", *url_filter.both_grams(host, path, url_filter.Settings()))
    n = Counter((r["label"], r["b"]) for r in held.select("label", (url_filter._logit(*model) >= 0).cast("int").alias("b")).collect())
    assert n[1, 1] >= 0.97 * (n[1, 1] + n[1, 0]) and n[1, 1] >= 0.97 * (n[1, 1] + n[0, 1])


def test_url_page_numbers_say_nothing(spark):
    pages = spark.createDataFrame([(i, f"http://m.quiet-river.example.com/en/{i * 37}.html", "h") for i in range(20)], "page_id long, url string, html string")
    assert len({(r["verdict"], r["score"]) for r in url_filter.judge(pages).collect()}) == 1


# 5


def test_fm_index_against_scanning():
    rng = np.random.default_rng(3)
    text = rng.integers(0, 5, 400)
    text[-1] = 0
    full = [(text[i:].tolist() + [0]).index(0) for i in range(len(text))]
    order = suffix_array(text).tolist()
    keys = [tuple(text[i : i + full[i]].tolist()) for i in order]
    assert sorted(order) == list(range(400)) and all(a[: len(b)] <= b or a <= b for a, b in zip(keys, keys[1:], strict=False))
    index = FMIndex(text, 4)
    for size in (1, 2, 3, 5):
        patterns = rng.integers(1, 5, (60, size))
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high, strict=True):
            places = [i for i in range(400 - size + 1) if np.array_equal(text[i : i + size], p)]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == places


def contaminated_by_hand(text, items, window=10):
    tok = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    ws, hit, found = tok(text), set(), set()
    for item_id, item in items:
        x = tok(item)
        k = min(window, len(x))
        for j in range(len(x) - k + 1 if x else 0):
            for i in range(len(ws) - k + 1):
                if ws[i : i + k] == x[j : j + k]:
                    hit |= set(range(i, i + k))
                    found.add(item_id)
    return ws, hit, found


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_decontamination(spark, block):
    import hashlib

    items = [(1, words(14, 50)), (12, "Short ITEM, here"), (3, None), (4, "..."), (5, words(10, 51)), (6, words(14, 50))]
    a, b = words(14, 50), words(10, 51)
    texts = [
        (0, a), (1, "x " + a.upper().replace(" ", ", ") + " y"), (2, b[:-3] + "zz"), (3, "short\nitem HERE short item here."), (4, None), (5, ""), (6, b + " mid " + b + " " + a), (7, words(300, 8)),
        (7, " ".join(a.split()[2:13])), (8, "é" + a), (9, "ÉÉ " + b + " ñ end"),
    ]
    df, bench = docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    settings = decontaminate_fm.Settings(block_bytes=block, shard_bytes=200, segment_words=20 if block == 60 else 1 << 20)
    expected = Counter()
    for i, t in texts:
        ws, hit, found = contaminated_by_hand(t, items)
        expected[i, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)] += 1
    got = decontaminate_fm.report(df, bench, settings=settings)
    assert by_row(got, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]) == expected
    cleaned = decontaminate_fm.remove_spans(df, bench, settings=settings)
    assert cleaned.columns == df.columns
    left = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    assert 0 not in left and left[7] == words(300, 8) or left[7] is not None
    assert left[9] == "ÉÉ  ñ end" and left[4] is None and left[5] == ""
    assert all(not contaminated_by_hand(t, items)[1] for t in left.values())
    assert decontaminate_fm.report(df.limit(0), bench).count() == 0 and decontaminate_fm.report(df, bench.limit(0)).filter("contaminated").count() == 0


# 6


def test_tokens_round_trip(spark, corpus, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = sorted(((r["doc_id"], r["text"] or "") for r in corpus.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    expected, at = [], 0
    for i, t in rows:
        ids = model.encode(t, add_special_tokens=False).ids + [1]
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    settings = token_output.Settings(shard_bytes=6000)
    manifest = token_output.write(corpus, f"file://{tmp_path}/t", settings=settings)
    assert manifest.count() > 2
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_output.read(manifest).collect()]
    assert Counter(got) == Counter(expected)
    assert token_output.lookup(manifest, 105) == [model.encode(words(65, 5), add_special_tokens=False).ids + [1]]
    assert len(token_output.lookup(manifest, 113)) == 2 and token_output.lookup(manifest, 10**9) == [] and len(token_output.lookup(manifest, None)) == 1
    assert token_output.token_output(corpus.limit(0)).count() == 0
    # Shards that keep the input's order: sorted within, one after the other, found through ranges and Bloom filters.
    mixed = corpus.repartition(3)
    loose = token_output.write(mixed, f"file://{tmp_path}/u", settings=token_output.Settings(ordered=False))
    rows = sorted((r["start"], r["n_tokens"], r["doc_id"], r["ids_crc32"]) for r in token_output.read(loose).collect())
    assert Counter((i, n, c) for _, n, i, c in rows) == Counter((i, n, c) for i, _, n, c in expected) and all(a[0] + a[1] == b[0] for a, b in zip(rows, rows[1:], strict=False))
    assert loose.count() == 3 and token_output.lookup(loose, 105) == token_output.lookup(manifest, 105) and len(token_output.lookup(loose, 113)) == 2


def test_sstable_file(tmp_path):
    keys = sorted({sstable.key_of(int(x)) for x in np.random.default_rng(1).integers(-(2**62), 2**62, 500)})
    with open(tmp_path / "t", "wb") as f:
        w = sstable.Writer(f, block_bytes=300)
        for k in keys:
            w.add(k, k[::-1] * 3)
        w.close()
    with open(tmp_path / "t", "rb") as f:
        r = sstable.Reader(f)
        assert [k for k, _ in r] == keys and len(r.places) > 10 and all(r.get(k) == [k[::-1] * 3] for k in keys[::17])
        assert sum(bool(r.get(sstable.key_of(i))) for i in range(200)) == 0
    raw = bytearray((tmp_path / "t").read_bytes())
    raw[20] ^= 1
    (tmp_path / "t").write_bytes(raw)
    with open(tmp_path / "t", "rb") as f, pytest.raises(ValueError):
        list(sstable.Reader(f))


# 7


def fingerprint_by_hand(text):
    import xxhash

    ws = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))] if ws else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, corpus):
    got = simhash_vptree.near_duplicates(corpus)
    assert by_row(got, ["doc_id", "fingerprint"]) == Counter((r["doc_id"], f"{fingerprint_by_hand(r['text']):016x}") for r in corpus.collect())
    ids = {r["doc_id"]: r["component_id"] for r in got.collect()}
    assert ids[112] == ids[113] == 100 and ids[0] == ids[1] == ids[2] == 0
    assert simhash_vptree.near_duplicates(corpus.limit(0)).count() == 0


def test_links_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 2**64, 60, dtype=np.uint64)
    fps = np.unique(np.concatenate([centres] + [c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (40, 3), dtype=np.uint64), axis=1) for c in centres[:20]] + [rng.integers(0, 2**64, 500, dtype=np.uint64)]))
    df = spark.createDataFrame([(int(x), int(x)) for x in fps.view(np.int64)], "node long, w0 long")
    place = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    # With a shallow first tree, large leaves get trees of their own.
    for settings in (simhash_vptree.Settings(leaf=32, sample=300), simhash_vptree.Settings(leaf=16, sample=16)):
        edges = [(r["a"], r["b"]) for r in simhash_vptree.links(df, settings).collect()]
        a, b = np.array([[place[x], place[y]] for x, y in edges]).T
        assert np.array_equal(least_labels(len(fps), a, b), least_labels(len(fps), i, j))


def test_classes_against_all_pairs(spark, corpus):
    rng = np.random.default_rng(8)
    texts = []
    for i in range(40):
        ws = words(200, i, 3000).split()
        for k in range(4):
            texts.append((1000 + 4 * i + k, " ".join(ws)))
            ws[int(rng.integers(0, 200))] = f"x{k}"
    df = docs_of(spark, texts + [(r["doc_id"], r["text"]) for r in corpus.collect()])
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash_vptree.near_duplicates(df, settings=simhash_vptree.Settings(leaf=16, sample=64)).collect()}
    fps = np.array([int(f, 16) for _, f in got], np.uint64)
    label = least_labels(len(fps), *np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4))
    ids = [i for i, _ in got]
    least = {x: min((i for i, y in zip(ids, label.tolist(), strict=True) if y == x and i is not None), default=None) for x in set(label.tolist())}
    assert list(got.values()) == [least[x] for x in label.tolist()] and 40 < len(set(label.tolist())) < len(fps)


def test_components(spark):
    rng = np.random.default_rng(3)
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 400)] + [(2500 - i, 2999) for i in range(300)]
    for edges in (chain, rng.integers(0, 3000, (1500, 2)).tolist(), []):
        label = least_labels(3000, *np.array(edges, np.int64).reshape(-1, 2).T)
        df = spark.createDataFrame([tuple(e) for e in edges], "a long, b long").repartition(7)
        for most in (1 << 20, 20):
            got = {r["node"]: r["root"] for r in components(df, most).collect()}
            assert [got.get(x, x) for x in range(3000)] == label.tolist()


def jaccard_by_hand(a, b):
    a, b = ({tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(a & b) / len(a | b)


def test_near_duplicates_stage(spark):
    import corpus_pipeline

    rng, texts, want = np.random.default_rng(4), [], {}
    for i in range(60):
        ws = words(300, i, 5000).split()
        texts.append((2 * i, " ".join(ws)))
        for at in rng.choice(300, 2 + i % 12, replace=False):
            ws[at] = f"new{at}"
        texts.append((2 * i + 1, " ".join(ws)))
        want[i] = jaccard_by_hand(texts[-2][1], texts[-1][1])
    assert sum(0.8 <= s < 0.9 for s in want.values()) >= 10 and sum(s < 0.8 for s in want.values()) >= 10
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    kept = stage(spark, docs_of(spark, texts), "")
    assert {r["doc_id"] for r in kept.collect()} == {2 * i for i in want} | {2 * i + 1 for i, s in want.items() if s < 0.8}
    # A chain in which the two ends are not similar, and rows with repeated, null and clashing ids.
    base = words(300, 900, 5000).split()
    step = [" ".join(["a", "b", "c", "d"] * k + base[30 * k :]) for k in range(3)]
    assert jaccard_by_hand(step[0], step[1]) >= 0.8 and jaccard_by_hand(step[1], step[2]) >= 0.8 > jaccard_by_hand(step[0], step[2])
    odd = [(i, t) for i, t in enumerate(step)] + [(9, words(50, 901)), (9, words(50, 901)), (None, words(50, 902)), (None, words(50, 902)), (8, words(50, 903)), (8, words(50, 901))]
    got = Counter((r["doc_id"], r["text"]) for r in stage(spark, docs_of(spark, odd), "").collect())
    assert got == Counter([(0, step[0]), (8, words(50, 901)), (None, words(50, 902)), (8, words(50, 903))])
    assert stage(spark, docs_of(spark, []), "").count() == 0
    # The same in small blocks, of which every two of a cluster meet.
    small = near_copies.keep_one(docs_of(spark, texts + odd), settings=near_copies.Settings(block_bytes=3000))
    assert Counter((r["doc_id"], r["text"]) for r in small.collect()) == Counter((r["doc_id"], r["text"]) for r in stage(spark, docs_of(spark, texts + odd), "").collect())


# 8


def templates_by_hand(docs, depth=3, similarity=0.6, most=10, words=100, long_line=20, share=1e-6):
    """Lines dropped of each row (id, text)."""
    def mask(line):
        tokens = [t for t in re.split(r"[\x20\x09-\x0d]+", line) if t]
        return ["<*>" if re.search("[0-9]", t) else t for t in tokens]

    def needed(size):
        n = min(most, max(2, -(-words // size)))
        return max(n, int(np.ceil(share * len(docs)))) if size < long_line else n

    seen, first = defaultdict(set), {}
    for i, text in docs:
        doc = (i, text) if i is None else i
        for line in (text or "").split("\n") if text is not None else []:
            if m := mask(line):
                leaf = (len(m), *m[:depth])
                seen[tuple(m)].add(doc)
                first.setdefault((doc, leaf), tuple(m))
    docs_of_leaf, constant = Counter(leaf for _, leaf in first), Counter()
    for (_, leaf), m in first.items():
        constant.update((leaf, i, m[i - 1], m[i]) for i in range(depth, len(m)))

    def goes(m):
        leaf, size = (len(m), *m[:depth]), len(m)
        if docs_of_leaf[leaf] < needed(size):
            return False
        fixed = sum(constant[leaf, i, m[i - 1], m[i]] >= needed(size) for i in range(depth, size))
        return len(seen[m]) >= needed(size) or (size > depth and fixed >= similarity * (size - depth))

    return [None if text is None else [k for k, line in enumerate(text.split("\n")) if mask(line) and goes(tuple(mask(line)))] for _, text in docs]


def test_line_templates(spark):
    prose = lambda n, seed: words(n, seed).translate(str.maketrans("0123456789", "abcdefghij"))  # noqa: E731  digits would be variable fields
    many = [(i, f"Copyright {2000 + i} all rights reserved\nunique {chr(97 + i) * 3} tail\n\nPage {i} of 90") for i in range(12)] + [(50, None), (51, ""), (52, "Page 3 of"), (53, "  \n"), (54, "a single line")]
    # Two templates of one leaf with a variable field, unrelated lines in that leaf, and lines of a few common words.
    many += [(100 + i, f"error code from host alpha user {chr(97 + i)}x done ok now") for i in range(20)]
    many += [(130 + i, f"error code from disk full on {chr(97 + i)}y please wait here") for i in range(14)]
    many += [(150, "error code from nowhere that anybody ever heard of yet"), (151, "error code from a b c d e f g")]
    many += [(160 + i, f"I want to {w}") for i, w in enumerate("go eat sleep read walk run swim sing dance cook drive fly".split())]
    # A long passage with edits, each in two documents or more; a long line of one document, said twice there.
    passage = prose(60, 31).split()
    for k in range(6):
        edited = list(passage)
        edited[10 + 7 * k] = f"edit{chr(97 + k)}"
        many.append((200 + k, prose(40, 300 + k) + "\n" + " ".join(edited)))
    many += [(210, prose(55, 77) + "\n" + prose(55, 77)), (None, "Page 4 of 7"), (None, "Page 4 of 7"), (0, many[0][1]), (211, "x y z " * 4000 + "\n" + "\n".join(prose(3, i) for i in range(3000)))]
    df = docs_of(spark, many)
    got = [(r["doc_id"], r["kept_text"], r["n_lines"], r["n_dropped"]) for r in line_templates.dedup(df).select("row.doc_id", "n_lines", "n_dropped", "kept_text").collect()]
    want = []
    for (i, text), gone in zip(many, templates_by_hand(many), strict=True):
        lines = [] if text is None else text.split("\n")
        want.append((i, None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone or [])))
    assert Counter(got) == Counter(want)
    by_id = {i: (kept, n) for i, kept, _, n in got}
    assert all(by_id[100 + i][1] == 1 for i in range(20)) and all(by_id[130 + i][1] == 1 for i in range(14)) and by_id[150][1] == by_id[151][1] == 0
    assert all(by_id[160 + i][1] == 0 for i in range(12)) and all(by_id[200 + k] == (prose(40, 300 + k), 1) for k in range(6)) and by_id[210][1] == 0
    deep = line_templates.dedup(df, settings=line_templates.Settings(depth=1)).select("row.doc_id", "n_dropped").collect()
    assert Counter((r["doc_id"], r["n_dropped"]) for r in deep) == Counter((i, len(g or [])) for (i, _), g in zip(many, templates_by_hand(many, depth=1), strict=True))
    assert line_templates.dedup(df.limit(0)).count() == 0


def test_line_templates_count_every_line(spark):
    """Not only a document's first line in a leaf makes templates; a document still counts once."""
    own = lambda i: "error code from " + " ".join(f"{chr(97 + i)}{w}" for w in "the quick brown fox jumps over it".split())
    user = lambda i, host="alpha": f"error code from host {host} user {chr(97 + i)}x done ok now"
    rows = [(i, own(i) + "\n" + user(i)) for i in range(20)]
    kept = lambda rows: {r["doc_id"]: r["kept_text"] for r in line_templates.dedup(docs_of(spark, rows)).select("row.doc_id", "kept_text").collect()}
    assert kept(rows) == {i: own(i) for i in range(20)}
    assert kept([(i, user(i) + "\n" + own(i)) for i in range(20)]) == {i: own(i) for i in range(20)}
    # Lines of ten tokens need ten documents: six with one line of the leaf and four with three, but not nine with many.
    many = lambda i: "\n".join([own(i), user(i), user(i + 5)])
    assert kept([(i, user(i)) for i in range(6)] + [(i, many(i)) for i in range(6, 10)]) == {i: own(i) if i > 5 else "" for i in range(10)}
    nine = [(i, user(i)) for i in range(6)] + [(i, many(i)) for i in range(6, 9)]
    assert kept(nine + [(8, many(8))]) == dict(nine)
    # Any mixture of lines, repeated rows and null ids against a count of all lines.
    rng = np.random.default_rng(8)
    say = lambda: ["a b c " + " ".join(rng.choice(list("uvw"), n, p=[0.6, 0.3, 0.1])) for n in rng.integers(5, 10, rng.integers(1, 6))]
    table = [(i, "\n".join(say())) for i in range(60)] + [(None, "\n".join(say())) for _ in range(3)]
    table += table[5:9] + table[-2:]
    need = lambda size: min(10, max(2, -(-100 // size)))
    leaf, just, pair = defaultdict(set), defaultdict(set), defaultdict(set)
    for i, text in table:
        for line in text.split("\n"):
            m, doc = tuple(line.split()), text if i is None else i
            leaf[len(m)].add(doc)
            just[m].add(doc)
            for k in range(3, len(m)):
                pair[len(m), k, m[k - 1], m[k]].add(doc)
    goes = lambda m: len(leaf[len(m)]) >= need(len(m)) and (len(just[m]) >= need(len(m)) or sum(len(pair[len(m), k, m[k - 1], m[k]]) >= need(len(m)) for k in range(3, len(m))) >= 0.6 * (len(m) - 3))
    want = Counter((i, "\n".join(x for x in text.split("\n") if not goes(tuple(x.split())))) for i, text in table)
    assert 0 < sum(goes(m) for m in just) < len(just)
    assert Counter((r["doc_id"], r["kept_text"]) for r in line_templates.dedup(docs_of(spark, table)).select("row.doc_id", "kept_text").collect()) == want


# 9


def test_warc(spark, tmp_path):
    import base64
    import hashlib

    rows = [(0, "http://a", "same"), (5, "http://b\r\nX: y", "same"), (3, None, "same"), (7, "u", None), (8, "u", ""), (9, "ü", "é" * 3000), (-4, "u", "same"), (9, "ü", "é" * 3000), (None, "u", "same"), (None, "u", "no id"), (None, "v", "no id")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, refers_to string")
    manifest = warc_revisit.write(pages, f"file://{tmp_path}/w")
    got = by_row(warc_revisit.read(manifest), ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    expected, seen = Counter(), set()
    for i, _, h in sorted(rows, key=lambda r: -(10**9) if r[0] is None else r[0], reverse=True):
        raw = (h or "").encode()
        last = max((j for j, _, k in rows if (k or "") == (h or "") and j is not None), default=None)
        first = raw not in seen
        seen.add(raw)
        expected[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first else last] += 1
    assert got == expected
    every = [(head, b) for r in manifest.collect() for head, b in warc_revisit.records(r["path"])]
    bodies = [b for head, b in every if head["warc-type"] == "response"]
    assert any(b.endswith(b"same") for b in bodies) and sum(b.endswith(b"same") for b in bodies) == 1
    urns = {head["warc-record-id"]: head for head, _ in every}
    assert len(urns) == len(rows) and all(urns[head["warc-refers-to"]]["warc-payload-digest"] == head["warc-payload-digest"] for head, _ in every if head["warc-type"] == "revisit")
    # Short payloads stay responses if asked for, and a changed payload is found out.
    long_only = warc_revisit.archive(pages, settings=warc_revisit.Settings(least_bytes=5))
    assert long_only.filter("record_type = 'revisit'").count() == 2
    head, block = next(x for x in every if x[1].endswith(b"same"))
    with pytest.raises(ValueError):
        warc_revisit._row(head, block[:-1] + b"f")
    assert warc_revisit.archive(pages.limit(0)).count() == 0


# 10


def segments_by_hand(scores):
    """All maximal segments, by repeatedly taking the best one and what is left of and right of it."""
    best, at = 0, None
    for i in range(len(scores)):
        total = 0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-12:
                best, at = total, (i, j + 1)
    if at is None:
        return []
    a, b = at
    return [*segments_by_hand(scores[:a]), (a, b, best), *((x + b, y + b, s) for x, y, s in segments_by_hand(scores[b:]))]


def test_maximal_segments():
    rng = np.random.default_rng(4)
    for n in (0, 1, 5, 40):
        for _ in range(30):
            x = rng.normal(-0.2, 1, n)
            got, want = toxicity_segments.maximal_segments(x), segments_by_hand(x.tolist())
            assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
            assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_toxicity(spark):
    rng = np.random.default_rng(6)
    bad = ["vile", "nasty", "rotten"]
    texts, labels = [], []
    for i in range(600):
        ws = words(80, i).split()
        toxic = i % 5 == 0
        if toxic:
            at = int(rng.integers(0, 60))
            ws[at : at + 8] = [bad[int(x)] if k % 2 == 0 else ws[at + k] for k, x in enumerate(rng.integers(0, 3, 8))]
        texts.append((i, " ".join(ws)))
        labels.append((i, int(toxic), 1))
    texts += [(900 + i, t) for i, t in enumerate(ODD)] + [(None, "vile nasty rotten vile"), (5, texts[5][1])]
    labels += [(1, None, 1), (None, 1, 1), (0, 1, 1)]
    df = docs_of(spark, texts)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    got = toxicity_segments.predicted(toxicity_segments.score(df, lab)).collect()
    assert len(got) == len(texts)
    wrong = 0
    for r in got:
        held = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2
        assert r["held_out"] == held and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        if held and r["doc_id"] < 600:
            wrong += r["predicted"] != int(r["doc_id"] % 5 == 0)
    assert wrong <= 3
    assert {r["score"] for r in toxicity_segments.score(df, lab.filter("toxic = 0")).collect()} == {0.0}
    assert toxicity_segments.score(df.limit(0), lab).count() == 0


# The pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    leak = words(20, 77, 10**6)
    texts = [(i, words(80, i)) for i in range(60)] + [(60, words(80, 0)), (61, words(80, 1) + " tail"), (62, "too short"), (63, "spam " * 100), (64, None), (65, leak), (66, words(90, 500) + " " + leak)]
    docs_of(spark, texts).drop("row", "kept").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = f"file://{tmp_path}"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_rules"](spark, docs, d)
    ids = {r["doc_id"] for r in good.collect()}
    assert good.columns == docs.columns and ids >= set(range(62)) and not ids & {62, 63, 64}
    single = stages["near_duplicates"](spark, good, d)
    assert {r["doc_id"] for r in single.collect()} == {r["doc_id"] for r in good.collect()} - {60, 61}
    clean = stages["decontamination"](spark, single, d)
    left = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert 65 not in left and leak not in left[66] and left[5] == words(80, 5)
    mixed = stages["mixing"](spark, clean, d)
    assert mixed.columns == docs.columns
    final = corpus_pipeline.run(spark, d)
    n = mixed.count()
    rows = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in final.collect())
    assert len(rows) == n and all(a + b == c for (a, b, _), (c, _, _) in zip(rows, rows[1:], strict=False))
    assert Counter(r[2] for r in rows) == Counter(r["doc_id"] for r in mixed.collect())


def test_pipeline_stages_take_odd_tables(spark, tmp_path):
    import corpus_pipeline

    # Names that the stages use themselves, nulls in every column, repeated rows, odd and long texts, nothing at all.
    names = ["row", "kept", "key", "node", "cut", "spans", "items", "mix_copies", "rate", "source_", "band_lang", "at", "leaf"]
    texts = [(i, words(60, i)) for i in range(40)] + [(100 + i, t) for i, t in enumerate(ODD)] + [(3, words(60, 3))] * 2 + [(None, words(60, 70)), (None, None), (7, None)]
    rows = [(i, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else f"s{k % 3}", None if t is None else len(t), *[f"c{k}"] * len(names)) for k, (i, t) in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, words(12, 5)), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    d, known = f"file://{tmp_path}", {(r[0], r[1], r[5]) for r in rows}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, df, d)
        kept[name] = [(r["doc_id"], r["text"], r["row"]) for r in got.collect()]
        assert got.columns == df.columns and got.schema == df.schema
        assert name == "decontamination" or set(kept[name]) <= known
        assert stage(spark, df.limit(0), d).count() == 0
    assert {t for _, t, _ in kept["quality_rules"]} >= {words(60, i) for i in range(40)} and None not in {t for _, t, _ in kept["quality_rules"]}
    single = Counter(t for _, t, _ in kept["near_duplicates"])
    assert all(single[words(60, i)] == 1 for i in range(40)) and sum(single[t] for t in (None, "", " \n\t ")) == 1
    clean = [t for i, t, _ in kept["decontamination"] if i == 5]
    assert len(kept["decontamination"]) == len(rows) and words(12, 5) not in clean[0] and corpus_pipeline.decontamination(spark, df, f"{d}/none").count() == len(rows)
    tokens = corpus_pipeline.token_ids(spark, df, d)
    assert tokens.count() == len(rows) and corpus_pipeline.token_ids(spark, df.limit(0), d).count() == 0
    assert corpus_pipeline.run(spark, d).count() > 0
