"""Each operator against a plain version of itself, and on odd and empty tables."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.llm import decontaminate, hmm_lm, html_extract, language_id, license_scan, near_dedup, packing, quality_classifier, quality_rules, queries, url_filter
from cairn.llm._shared import Words, pieces, table_of

SF = "/root/testdata/sf0.01"


def low(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


# shared


def test_words_of_pieces():
    texts = ["Ab  cd", None, "", " x", "é ñ\u00a0z", "end ", "a" * 50, "A b"]
    for limit in (1, 10, 1000):
        got = {}
        for a, b, data, bounds in pieces(pa.array(texts), limit):
            w = Words(data, bounds, table_of())
            for r in range(b - a):
                i, n = int(w.first[r]), int(w.count[r])
                got[a + r] = [(w.word(k).decode(), int(w.hashes[k])) for k in range(i, i + n)]
        assert [[x for x, _ in got[i]] for i in range(len(texts))] == [split(low(t)) for t in texts]
        assert len({h for row in got.values() for _, h in row}) == len({x for row in got.values() for x, _ in row})


# 1


def test_language_held_out(spark):
    got = queries.op1_language_id(spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got)


def test_language_backs_off_to_grams():
    tables = [Counter({"haus": 5, "baum": 4, "schnee": 3}), Counter({"house": 5, "tree": 4, "snow": 3})]
    model = language_id._build(["de", "en"], tables, 1000)
    assert model.predict("haus")[0] == "de" and model.predict("schneebaum")[0] == "de" and model.predict("snowhouse")[0] == "en"
    assert model.predict("12 !!") == ("und", 0.0) and model.predict(None) == ("und", 0.0)


def test_language_cache_turns_over(monkeypatch):
    monkeypatch.setattr(language_id, "CACHED", 5)
    model = language_id._build(["de", "en"], [Counter({"haus": 5}), Counter({"house": 5})], 100)
    fresh = language_id._build(["de", "en"], [Counter({"haus": 5}), Counter({"house": 5})], 100)
    for i in range(40):
        text = " ".join(f"word{chr(97 + (i * k) % 26)}x" for k in range(1, 12))
        assert model.predict(text) == fresh.predict(text)
        fresh.known = {w: i for w, i in fresh.known.items() if i < fresh.n_known}


def test_every_language_is_learned(spark):
    """The rarest of 66 languages too, with all its words."""
    rows = [(100 * g + i, " ".join(f"{chr(97 + g % 26)}{chr(97 + g // 26)}{chr(97 + k)}" for k in range(6)), f"l{g}") for g in range(66) for i in range(1 if g > 63 else 2)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_words=6)
    assert len(model.langs) == 66 and model.n_known == 66 * 6 and model.predict(rows[-1][1])[0] == "l65"


def test_language_odd(spark, odd, empty):
    got = language_id.predict(odd, language_id.fit(odd)).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (0, 1, 2, 5)} == {"und"}
    assert language_id.predict(odd, language_id.fit(empty)).where("lang_pred <> 'und'").count() == 0
    assert language_id.predict(empty, language_id.fit(empty)).count() == 0


# 2


def plain_licenses(text):
    lower = low(text)
    units = {u for p in (r"\n+|(?<=[.!?:;])\s+", r"\n", r"\n\s*\n") for u in re.split(p, lower)} | {lower}
    best = (0.0, None)
    for u in units:
        words = re.findall("[a-z0-9]+", u)
        mine = set(zip(words, words[1:], strict=False))
        for name, texts in license_scan.TEMPLATES.items():
            for t in texts:
                other = {tuple(b.split(" ")) for b in license_scan.bigrams_of(t)}
                if mine:
                    best = max(best, (2 * len(mine & other) / (len(mine) + len(other)), name), key=lambda x: x[0])
    return best if best[0] >= license_scan.LEAST else (None, None)


def test_licenses_against_plain(spark):
    rng, rows = random.Random(2), []
    every = [t for texts in license_scan.TEMPLATES.values() for t in texts]
    for i in range(150):
        words = rng.choice(every).split(" ")
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(words))
            words[k : k + 1] = rng.choice([[], ["other"], [words[k].upper(), "more"]])
        lead = rng.choice(["", "Some text. ", "Title\n", "words before it "])
        rows.append((i, lead + " ".join(words) + rng.choice(["", "\nAnd after.", " Then more follows here."])))
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        dice, _ = plain_licenses(text)
        assert (got[i]["dice"] is None) == (dice is None) and (dice is None or got[i]["dice"] == pytest.approx(dice)), text


def test_licenses_odd(odd, empty):
    assert license_scan.scan_licenses(odd).where("license is not null or n_units <> 0").count() == 0
    assert license_scan.scan_licenses(odd).count() == odd.count() and license_scan.scan_licenses(empty).count() == 0


# 3


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = split(low(t))
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def plain_components(sets):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def test_near_duplicates_against_plain(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)  # several blocks
    rng, rows = random.Random(3), []
    for base in range(6):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 5, 60, 150]))]
        for _ in range(rng.choice([1, 2, 30, 90])):
            copy = list(words)
            for _ in range(rng.randrange(max(1, len(words) // 15))):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(5000)}"
            rows.append((len(rows) * 3 + base % 2, rng.choice([" ", "\n"]).join(copy).upper() if rng.random() < 0.2 else " ".join(copy)))
    sets = sets_of(rows)
    want = plain_components(sets)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_super_minhash_estimates():
    rng = np.random.default_rng(5)
    for share in (0.3, 0.75, 0.95):
        est = []
        for _ in range(30):
            n = 200
            both = rng.integers(0, 1 << 62, int(n * 2 * share / (1 + share))).astype(np.uint64)
            own = [np.concatenate([both, rng.integers(0, 1 << 62, n - len(both)).astype(np.uint64)]) for _ in range(2)]
            items = np.concatenate([np.unique(x) for x in own])
            s = near_dedup.super_minhash(items, np.array([0, len(np.unique(own[0])), len(items)]))
            est.append((s[0] == s[1]).mean())
        assert abs(np.mean(est) - share) < 0.03


def test_near_duplicates_odd(spark, odd, odd_rows, empty):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == len(odd_rows) and near_dedup.near_duplicates(empty).count() == 0
    by = {r["doc_id"]: r for r in got}
    assert by[4]["component_id"] == 3 and not by[4]["kept"]
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
    assert all(by[i]["n_shingles"] == 0 and by[i]["kept"] for i in (0, 1, 2))
    assert by[10]["component_id"] == 8


# 4


def plain_hits(docs, items, width=8):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t))
    windows = {}
    for i, t in items:
        w = cut(t)
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, held = cut(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    held |= windows[tuple(w[k : k + n])]
                    hit.update(range(k, k + n))
        out.append((d, len(w), len(hit), tuple(sorted(held))))
    return sorted(out, key=str)


def test_decontamination_against_plain(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(["the", "of", "a", "Ü", "x9"] + [f"w{rng.randrange(60)}" for _ in range(6)])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 8, 9, 30])))) for i in range(25)] + [(99, None)]
    items += [(50, items[5][1]), (51, "the the the the the the the the")]
    docs = []
    for d in range(80):
        parts = [word() for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            t = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(t) + 1)
            parts[len(parts) // 2 : len(parts) // 2] = t[a : a + rng.randrange(5, 20)]
        docs.append((d, rng.choice([" ", ", ", "-"]).join(parts)))
    docs += [(200, None), (201, "the " * 12)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = plain_hits(docs, items)
    for size in (1 << 20, 100):
        got = decontaminate.contamination(*frames, block_bytes=size).collect()
        assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got], key=str) == want


def test_decontamination_odd(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(odd, none).where("n_items > 0").count() == 0
    assert decontaminate.contamination(odd, odd.selectExpr("doc_id as item_id", "text")).count() == odd.count()
    assert decontaminate.contamination(empty, none).count() == 0


# 5


def test_urls_against_plain(spark):
    rng = random.Random(7)
    labels = ["a", "b", "com", "x-1"]
    host = lambda n: ".".join(rng.choice(labels) for _ in range(n))
    rules = [(host(rng.randrange(1, 4)), rng.choice(["/", "/p/", "/p/q/", ""]), rng.choice(["allow", "block"])) for _ in range(40)]
    urls = [f"{rng.choice(['http', 'HTTPS'])}://{rng.choice([str.upper, str.lower])(host(rng.randrange(1, 5)))}{rng.choice(['', '/', '/p/', '/p/q/r', '/x?y=/p/', '#f', '?q'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "://", "http://", "a://b://c/p/"]
    best = {}
    for h, p, v in rules:
        best[(h, p)] = "block" if best.get((h, p)) == "block" else v
    want = {}
    for i, u in enumerate(urls):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        h, p = (low(m[1]), m[2]) if m else ("", "")
        fit = [(len(a + b), len(a), a + b, v) for (a, b), v in best.items() if (h == a or h.endswith("." + a)) and p.startswith(b)]
        want[i] = (h, p, *(max(fit)[2:] if fit else (None, "allow")))
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    for most in (1000, 9):
        got = url_filter.filter_urls(frame, table, max_rules=most).collect()
        assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got} == want
    assert url_filter.filter_urls(frame, table.limit(0)).where("rule is not null").count() == 0
    assert url_filter.filter_urls(frame.limit(0), table).count() == 0


# 6

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class="home"><header><a href=/>Site</a> tagline</header>
<nav><ul><li><a>Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><div id=main class="wrap {kind}"><h1>Head &amp; more</h1><p>First <b>bo</b>ld<br>line {n}
 wraps.<script>var x="</p>";</script><p>Second&nbsp;one &#x41;&lt;<div class="ad">Buy</div><aside>See also</aside><ul><li>item one<li>item two</ul><form>Mail <input></form>
<section class="comments"><p>I agree</p></section></div><!-- c <p>no</p> --><footer>Foot</footer></body></html>"""


def test_extraction(spark):
    rows = [(n, f"http://h.example/{n}", PAGE.format(n=n, kind="content")) for n in range(6)]
    rows += [(10, "http://lone.example/", PAGE.format(n=10, kind="body")), (11, None, None), (12, "http://h.example/x", ""), (13, "http://h.example/y", "plain < text <b>here"), (14, "http://z.example/", "<article><p>cut off <a href='x"), (15, "http://z.example/2", "<article>one</article><div>no</div><article class=comment>c</article><article>two</article>")]
    rows.append(rows[0])
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r["text"] for r in got}
    for n in (*range(6), 10):
        assert by[n] == f"Head & more First bold line {n} wraps. Second one A< item one item two"
    assert by[11] == by[12] == "" and by[13] == "plain < text here" and by[14] == "cut off" and by[15] == "one two"
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_template_finds_the_varying_slot(spark):
    """Without any marked element, the container whose slot changes and holds the text is the content."""
    rng = random.Random(8)
    page = lambda n: f"<html><body><div class=a>{' '.join(f'w{rng.randrange(99)}' for _ in range(40))} {n}</div><div class=b>short {n}</div></body></html>"
    rows = [(n, f"http://h.example/{n}", page(n)) for n in range(8)]
    rows.append((8, "http://h.example/8", "<html><body><div class=a>few</div><div class=b>" + "long " * 50 + "</div></body></html>"))
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("short" not in got[n] for n in range(8)) and got[8] == "few"


def texts_of(spark, pages):
    rows = [(n, f"http://h.example/{n}", f"<html><body>{p}</body></html>") for n, p in enumerate(pages)]
    return {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def prose(rng, n):
    return " ".join(f"w{rng.randrange(999)}" for _ in range(n))


def test_template_text_is_no_slot(spark):
    """A block that is the same on a host's pages is template, however long."""
    rng = random.Random(3)
    about = "The same long words about this place on every page. " * 20
    got = texts_of(spark, [f"<div class=x>{about}</div><div class=y>{prose(rng, 30)} end{n}</div>" for n in range(8)])
    assert all("same long" not in got[n] and got[n].endswith(f"end{n}") for n in range(8))


def test_template_keeps_whole_articles(spark):
    """Ids of single pages, text over two containers, teasers beside main, and articles that only some pages have."""
    rng = random.Random(4)
    body = [prose(rng, 40) for _ in range(9)]
    got = texts_of(spark, [f"<div class=x>{prose(rng, 90)}</div><article id=post-{n} class=p{n}><div class=in{n}>{body[n]}</div></article>" for n in range(9)])
    assert all(got[n] == body[n] for n in range(9))
    got = texts_of(spark, [f"<div class=lead>{prose(rng, 12)} lead{n}</div><div class=rest>{body[n]} {body[n - 1]}</div>" for n in range(9)])
    assert all(f"lead{n}" in got[n] and got[n].endswith(body[n - 1]) for n in range(9))
    got = texts_of(spark, [f"<main>{body[n]}</main><article class=card>go {n}</article>" for n in range(9)])
    assert all(got[n] == body[n] for n in range(9))
    got = texts_of(spark, [f"<div class=x>{body[n]}</div>" + (f"<section><article>own{n}</article></section>" if n < 2 else "") for n in range(9)])
    assert all(got[n].endswith(f"own{n}") for n in range(2)) and got[5] == body[5]


# 7


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    got = quality_classifier.score(docs, labels.where(~held), F.col("source"), F.col("lang")).join(labels.where(held), "doc_id").collect()
    assert sum(r["good"] == (r["quality"] > 0) for r in got) >= 0.95 * len(got)


def test_quality_shrinks_sparse_hosts(spark):
    text = "Some plain words stand here in a row, and nothing else is to be seen. " * 3
    docs = [(i, text, f"h{i % 2}" if i < 200 else "few" if i < 202 else "new", "p") for i in range(210)]
    labels = [(i, int(i % 2 or i % 20 == 0)) for i in range(200)] + [(200, 1), (201, 1)]
    got = quality_classifier.score(spark.createDataFrame(docs, "doc_id long, text string, source string, part string"), spark.createDataFrame(labels, "doc_id long, quality int"), F.col("source"), F.col("part"))
    rate = {r["source"]: r["host_rate"] for r in got.join(spark.createDataFrame(docs, "doc_id long, text string, source string, part string").select("doc_id", "source"), "doc_id").select("source", "host_rate").distinct().collect()}
    overall = sum(q for _, q in labels) / len(labels)
    assert rate["h0"] < 0.25 < overall < rate["few"] < rate["h1"] and rate["new"] == pytest.approx(overall, abs=0.01)


def test_quality_odd(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(3, 1), (3, 0), (7, None), (None, 1), (12345, 0), (8, 0)], "doc_id long, quality int")
    for labels in (none, some):
        got = quality_classifier.score(odd, labels, F.col("source"), F.col("lang")).collect()
        assert len(got) == odd.count() and all(0 < r["score"] < 1 for r in got)
    assert quality_classifier.score(empty, none, F.col("source"), F.col("lang")).count() == 0


# 8


def plain_counts(text):
    words = split(text)
    lines = [x for x in (text or "").split("\n") if split(x)]
    seen, hit = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)), set()
    for i in range(len(words) - 4):
        if seen[tuple(words[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_rules_against_plain(spark, odd_rows, odd, empty):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice(["a ", "b ", "c ", "#", "\n", "\t", "é ", "x\u00a0y "]) for _ in range(rng.randrange(120))), "en") for i in range(80)]
    for frame, source in ((spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows), (odd, odd_rows)):
        got = quality_rules.quality_rules(frame).collect()
        key = lambda x: str(x)
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        assert sorted([(r["doc_id"], *(r[n] for n in names)) for r in got], key=key) == sorted([(r[0], *plain_counts(r[1])) for r in source], key=key)
        assert all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and not (r["kept"] and r["base_failed"]) for r in got)
    assert quality_rules.quality_rules(empty).count() == 0


def test_rules_see_divergence(spark):
    rng = random.Random(10)
    common, rare = quality_rules.COMMON["en"], [f"{chr(97 + i % 26)}{chr(97 + i // 26)}ver" for i in range(300)]
    plain = lambda: " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(rare) for _ in range(150))
    noise = lambda: " ".join("".join(rng.choice("%$#&*|~^0123456789") for _ in range(4)) for _ in range(150))
    rows = [(i, plain() if i < 60 else noise(), "en") for i in range(63)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i] == (i < 60) for i in got)


def test_rules_judge_texts_without_reference(spark):
    """Junk in no or another language is rejected at any length; other languages and scripts without case are not."""
    rng = random.Random(19)
    plain = " ".join(rng.choice(["the", "house", "of", "rivers", "and", "Some", "winding", "roads."]) for _ in range(300))
    junk = [" ".join(f"{rng.randrange(9999)} #{rng.randrange(99)}%" for _ in range(n)) for n in (8, 100)]
    other = [" ".join(rng.choice(words) + rng.choice(words).lower() for _ in range(40)) for words in (["Die", "rzeka", "domy", "żółć", "się", "drogi,", "wie"], ["नदी", "घर", "और", "सड़क", "पानी", "लोग"], ["نهر", "بيت", "طريق", "ماء", "ناس"])]
    rows = [(0, plain, "en"), *[(10 + i, t, g) for g, k in ((None, 0), ("xx", 2)) for i, t in enumerate(junk, k)], *[(20 + i, t, g) for g, k in ((None, 0), ("xx", 3)) for i, t in enumerate(other, k)]]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(not r["base_failed"] for r in got.values())
    assert {i for i, r in got.items() if r["kept"]} == {0, *range(20, 26)}


def test_distance(spark):
    p, q = [0.5, 0.3, 0.2, 0.0], [0.1, 0.2, 0.3, 0.4]
    want = math.sqrt(sum((a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0) for a, b in zip(p, q, strict=True)) / 2)
    got = spark.range(1).select(quality_rules._distance(F.array(*map(F.lit, p)), q).alias("d")).first()["d"]
    assert got == pytest.approx(want)


# 9


def test_boundaries_are_optimal():
    rng = random.Random(12)
    for _ in range(30):
        lengths = sorted(rng.sample(range(1, 60), rng.randrange(1, 9)))
        counts = [rng.randrange(1, 20) for _ in lengths]
        k = rng.randrange(1, 5)
        best = min(
            sum(c * (min(m for m in (*marks, lengths[-1]) if m >= n) - n) for n, c in zip(lengths, counts, strict=True))
            for size in range(min(k, len(lengths)))
            for marks in itertools.combinations(lengths[:-1], size)
        )
        marks, padding = packing.boundaries(np.array(lengths), np.array(counts), k)
        assert padding == best and len(marks) <= k and marks[-1] == lengths[-1]


def test_packing_keeps_all(spark, odd, empty):
    rng = random.Random(13)
    rows = [(i, " ".join("w" * (1 + k % 3) for k in range(rng.choice([0, 3, 50, 500])))) for i in range(300)] + [(999, "a b " * 700), (None, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(frame, max_tokens=600, token_budget=2000, buckets=4, shards=7).collect()
    total = Counter()
    for r in got:
        total[r["doc_id"]] += r["n_tokens"]
        assert 0 < r["n_tokens"] <= r["bucket"] and r["padding"] == r["bucket"] - r["n_tokens"]
    assert total == Counter({i: len(split(t)) + 1 for i, t in rows})
    assert len({r["bucket"] for r in got}) <= 4
    for bucket in {r["bucket"] for r in got}:
        size, mine = max(1, 2000 // bucket), [(r["batch"], r["slot"]) for r in got if r["bucket"] == bucket]
        assert sorted(mine) == [divmod(k, size) for k in range(len(mine))]
    assert sorted(r["piece"] for r in got if r["doc_id"] == 999) == [0, 1, 2]
    assert packing.pack(empty).count() == 0
    assert packing.pack(odd).agg(F.sum("n_tokens")).first()[0] == sum(len(split(r["text"])) + 1 for r in odd.select("text").collect())


def test_packing_is_exact_by_default(spark):
    """Few odd lengths are boundaries themselves: nothing is padded."""
    rows = [(i, " ".join(["w"] * n)) for i, n in enumerate([0, 2, 4, 10, 10, 0])]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["bucket"] for r in got) == [1, 1, 3, 5, 11, 11] and sum(r["padding"] for r in got) == 0


# 10


def model(rng, symbols=6):
    s = hmm_lm.STATES
    draw = lambda *n: rng.dirichlet(np.ones(n[-1]), n[0]) if len(n) > 1 else rng.dirichlet(np.ones(n[0]))
    return hmm_lm.Model(draw(s), draw(s, s), draw(s, symbols).T)


def test_forward_is_exact():
    rng = np.random.default_rng(14)
    m = model(rng)
    lines = [rng.integers(0, 6, n).astype(np.uint16) for n in (1, 2, 4, 3, 4)]
    got = hmm_lm.forward(m, lines)
    for line, log in zip(lines, got, strict=True):
        total = 0.0
        for path in itertools.product(range(hmm_lm.STATES), repeat=len(line)):
            p = m.start[path[0]]
            for t, k in enumerate(path):
                p *= (m.move[path[t - 1], k] if t else 1) * m.emit[line[t], k]
            total += p
        assert log == pytest.approx(math.log(total))


def test_forward_survives_long_lines():
    rng = np.random.default_rng(15)
    m = model(rng)
    line = rng.integers(0, 6, 20_000).astype(np.uint16)
    alpha, log = m.start * m.emit[line[0]], 0.0
    for x in line[1:]:
        c = alpha.sum()
        log, alpha = log + math.log(c), alpha / c @ m.move * m.emit[x]
    assert hmm_lm.forward(m, [line, line[:7]])[0] == pytest.approx(log + math.log(alpha.sum()))


def test_baum_welch_counts():
    """Expected counts of a line that fits one stretch equal those over all paths; training never lowers the likelihood."""
    rng = np.random.default_rng(16)
    m = model(rng)
    line = rng.integers(0, 6, 4).astype(np.uint16)
    s, want, total = hmm_lm.STATES, 0.0, 0.0
    for path in itertools.product(range(s), repeat=4):
        p = m.start[path[0]] * m.emit[line[0], path[0]]
        for t in range(1, 4):
            p *= m.move[path[t - 1], path[t]] * m.emit[line[t], path[t]]
        counts = np.zeros(s + s * s + 6 * s)
        counts[path[0]] += 1
        for t in range(4):
            counts[s + s * s + line[t] * s + path[t]] += 1
            if t:
                counts[s + path[t - 1] * s + path[t]] += 1
        want, total = want + p * counts, total + p
    np.testing.assert_allclose(hmm_lm.expected(m, [line]), want / total, rtol=2e-3, atol=1e-5)
    lines = [rng.integers(0, 3, 40).astype(np.uint16) + 3 * (i % 2) for i in range(30)]
    lines = [x.astype(np.uint16) for x in lines]
    unigram, logs = np.full(6, 1 / 6), []
    for _ in range(6):
        logs.append(hmm_lm.forward(m, lines).sum())
        m = hmm_lm.Model.of(hmm_lm.expected(m, lines), unigram)
    assert all(b > a - 1 for a, b in zip(logs, logs[1:], strict=False)) and logs[-1] > logs[0]


def test_baum_welch_carries_over_long_lines():
    """Expected counts of a long line are those of plain forward and backward passes over all of it."""
    rng = np.random.default_rng(17)
    m = model(rng)
    s, line = hmm_lm.STATES, rng.integers(0, 6, 400).astype(np.uint16)
    forth, back = [m.start * m.emit[line[0]]], [np.ones(s)]
    for x in line[1:]:
        forth.append(forth[-1] / forth[-1].sum() @ m.move * m.emit[x])
    for x in line[:0:-1]:
        b = m.move @ (m.emit[x] * back[-1])
        back.append(b / b.sum())
    back.reverse()
    want = np.zeros(s + s * s + 6 * s)
    for t, x in enumerate(line):
        g = forth[t] * back[t] / (forth[t] @ back[t])
        want[s + s * s + x * s : s + s * s + x * s + s] += g
        if t:
            step = forth[t - 1][:, None] * m.move * (m.emit[x] * back[t])
            want[s : s + s * s] += (step / step.sum()).ravel()
        else:
            want[:s] = g
    np.testing.assert_allclose(hmm_lm.expected(m, [line]), want, rtol=2e-3, atol=1e-3)


def test_training_settles_over_all_texts(spark):
    """A kind of text of one in a hundred is learned, and a further round over all texts adds next to nothing."""
    rng = np.random.default_rng(18)
    lines = [(rng.integers(0, 40, 60) + 40 * (i % 6 if i % 100 else 6)).astype(np.uint16) for i in range(3000)]
    frame = spark.createDataFrame([(i, False, len(x), bytearray(x.tobytes())) for i, x in enumerate(lines)], "row long, held boolean, n_tokens long, symbols binary")
    unigram = np.bincount(np.concatenate(lines), minlength=280) / sum(map(len, lines))
    m = hmm_lm.train(frame, unigram)
    n, log = sum(map(len, lines)), hmm_lm.forward(m, lines).sum()
    again = hmm_lm.Model.of(hmm_lm.expected(m, lines), unigram)
    assert hmm_lm.forward(again, lines).sum() - log < 0.005 * n
    rare = [x for i, x in enumerate(lines) if i % 100 == 0]
    assert hmm_lm.forward(m, rare).sum() > np.log(unigram[np.concatenate(rare)]).sum() + sum(map(len, rare))


def plain_base(rows, held):
    counts = Counter()
    tokens = lambda t: [*split(low(t)), None]
    for i, t in rows:
        if not held(i):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    return {i: (len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), n, sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens(t))) for i, t in rows}


def test_scores_against_plain(spark, monkeypatch):
    monkeypatch.setattr(hmm_lm, "COMMON", 40)  # most words take the way through the join
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()] + [(10_001, None), (10_002, " ")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in hmm_lm.score(frame, F.crc32(F.col("doc_id").cast("string")) % 10 == 0).collect()}
    want = plain_base(rows, lambda i: zlib.crc32(str(i).encode()) % 10 == 0)
    for i, (n, known, train, base) in want.items():
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (n, known, train)
        assert got[i]["base_score"] == pytest.approx(base, rel=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scores_odd(odd, empty):
    got = hmm_lm.score(odd, F.lit(False)).collect()
    assert len(got) == odd.count() and all(r["score"] < 0 for r in got)
    assert hmm_lm.score(empty, F.lit(False)).count() == 0
    assert hmm_lm.score(odd, F.lit(True)).where("train_tokens <> 0").count() == 0


# 6, the template


def test_equal_vectors_are_one_class(spark):
    """Classes against plain vectors of counts over a host's pages."""
    rng = random.Random(21)
    pages = [(n, f"<body><ul>{''.join(f'<li><div class=i>x{rng.random()}</div>' for _ in range(rng.randrange(1, 4)))}</ul><div class=same>always here</div><div class=b><p>{prose(rng, 9)}</div></body>" + ("<footer>f</footer>" if n % 3 else "")) for n in range(9)]
    each = spark.createDataFrame([("h", n, h) for n, h in pages], "host string, r long, html string").select("host", "html", "r").mapInArrow(html_extract._tokens, html_extract._schema((*html_extract._LONGS, "t", "n")))
    row = html_extract.classes(each).collect()
    assert len(row) == 1 and row[0]["all"] == 9
    vectors: dict[int, dict[int, int]] = {}
    for n, h in pages:
        page = html_extract.Page(h)
        for t in (*page.paths, *page.tags, *page.own_texts()):
            vectors.setdefault(t, {}).setdefault(n, 0)
            vectors[t][n] += 1
    want: dict[tuple, set[int]] = {}
    for t, v in vectors.items():
        if len(v) >= html_extract.SUPPORT * 9:
            want.setdefault(tuple(sorted(v.items())), set()).add(t)
    got: dict[int, set[int]] = {}
    for t, c in zip(row[0]["known"], row[0]["classes"], strict=True):
        got.setdefault(c, set()).add(t)
    assert len(want) > 3 and sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_classes_are_ordered_and_nested():
    plain = {c: (order, crossed, parent) for c, order, crossed, parent in html_extract.arranged([(0, 1, 10), (9, 1, 11), (1, 2, 20), (2, 2, 21), (3, 2, 20), (4, 2, 21), (5, 3, 30), (12, 3, 31)])}
    assert plain[2][0] and plain[2][1:] == (False, 1)  # repeats inside the gap of 1
    assert plain[1][1:] == (False, 0) and plain[3][1:] == (False, 1) or plain[1][1] != plain[3][1]  # 1 and 3 cross: one goes
    assert plain[1][1] + plain[3][1] == 1
    assert html_extract.arranged([(0, 1, 10), (1, 1, 11), (2, 1, 11), (3, 1, 10)])[0][1] == 0  # no one order
    a, b = (html_extract.arranged(e)[0][1] for e in ([(0, 1, 10), (1, 1, 11)], [(0, 1, 11), (1, 1, 10)]))
    assert a != b


def test_template_decides_where_pages_mislead(spark):
    """Boxes without any mark, in the same place on all pages: on some the side box is longer than the story."""
    rng = random.Random(5)
    story = [prose(rng, 12 if n % 3 == 0 else 120) for n in range(12)]
    side = [prose(rng, 40) if n % 3 == 0 else "go" for n in range(12)]
    pages = [f"<div class=q>{side[n]}</div><div class=r><p>{story[n]}</p></div>" for n in range(12)]
    alone = [html_extract.Page(p) for p in pages]
    assert sum(p.text(p.chosen(None, None)) != s for p, s in zip(alone, story, strict=True)) == 4
    got = texts_of(spark, pages)
    assert [got[n] for n in range(12)] == story


def test_extraction_odd(spark):
    text = lambda html: (p := html_extract.Page(html)).text(p.chosen(None, None))
    assert text("<article>one<svg/>two<math x='1' />three<svg><path/>no</svg></article>") == "onetwothree"
    assert text('<article><div class="entry-header"><h1>Title</h1></div><p class="text-notice">kept</p><div class="notice">no</div>body</article>') == "Title kept body"
    n = 10_000
    assert text("<div class=content>" * n + "deep" + "</div>" * n) == "deep"
    assert text("<div class=content><p>a" * n) == " ".join(["a"] * n)
    long_page = "<article>" + "<p>word</p>" * 100_000 + "</article>"
    rows = [("a", "http://h.example/1", long_page, "x", 1), (None, None, None, None, None), ("b", "no address", "<p>x", "y", 2), ("a", "http://h.example/1", long_page, "x", 1)]
    odd_pages = spark.createDataFrame(rows, "page_id string, url string, html string, text string, host long")
    got = sorted(map(tuple, html_extract.extract(odd_pages).select("page_id", "n_chars").collect()), key=str)
    assert got == [("a", 499_999), ("a", 499_999), ("b", 1), (None, 0)]


# 2, names


def test_licenses_are_told_apart(spark):
    """Versions and families that differ by a few words, each with its own name; other versions have none."""
    gpl = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    texts = {
        "GPL-2.0-or-later": gpl.format(2),
        "GPL-3.0-or-later": gpl.format(3),
        "LGPL-2.1": "Licensed under the GNU Lesser General Public License, version 2.1.",
        "LGPL-3.0": "licensed under the gnu lesser general public license version 3",
        "AGPL-3.0": "Licensed under the GNU Affero General Public License, version 3",
        "AGPL-3.0-or-later": gpl.format(3).replace("GNU General", "GNU Affero General"),
        "MPL-1.1": "Licensed under the Mozilla Public License, version 1.1.",
        "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "CC-BY-3.0": "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
        "CC-BY-4.0": "Licensed under CC BY 4.0.",
        "BSD-2-Clause": "Copyright A\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Keep this.",
        "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
        "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        None: gpl.format(7),
    }
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(spark.createDataFrame([(i, t) for i, t in enumerate(texts.values())], "doc_id long, text string")).collect()}
    for i, name in enumerate(texts):
        assert got[i]["license"] == name and got[i]["licenses"] == ([name] if name else []), (name, got[i])
    assert got[len(texts) - 1]["dice"] > 0.8 and got[len(texts) - 1]["n_units"] > 0


# 7, in full


def test_quality_against_plain(spark):
    """Counts, word scores, bins, shrunk rates and posteriors by plain loops over the labelled rows."""
    q = quality_classifier
    rng = random.Random(31)
    good, bad = [f"good{i}" for i in range(30)], [f"BAD{i}#" for i in range(30)]
    docs = []
    for i in range(90):
        y = int(i % 4 != 0)
        docs.append((i, " ".join(rng.choice((good if y else bad) + ["and", "the"]) for _ in range(rng.randrange(0, 40))), f"h{i % 5}", f"p{i % 3}", y))
    frame = spark.createDataFrame([d[:4] for d in docs], "doc_id long, text string, host string, path string")
    labels = [(i, y) for i, _, _, _, y in docs if i % 3 != 2] + [(0, 1), (4, None), (999, 1)]
    got = {r["doc_id"]: r for r in q.score(frame.repartition(3), spark.createDataFrame(labels, "doc_id long, quality int"), F.col("host"), F.col("path")).collect()}
    batch = next(iter(q._worded([q.features(frame, "doc_id", "text", F.col("host"), F.col("path")).coalesce(1).toArrow().combine_chunks().to_batches()[0]])))
    shapes = dict(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True))
    grams = {i: q.grams_of(x).tolist() for i, x in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), strict=True)}
    for i, text, *_ in docs:
        words, bins = text.split(), shapes[i][-3:]
        values = (len({w.lower() for w in words}) / max(1, len(words)), len("".join(words)) / max(1, len(words)), len(words))
        assert bins == [sum(v > e for e in q.EDGES[f]) for f, v in zip(q.BY_WORDS, values, strict=True)]
        assert len(set(grams[i])) == len(grams[i]) <= 2 * len(words)
    known = [(i, y) for i, y in labels if y is not None and i < 90]
    held = {0: Counter(), 1: Counter()}
    for i, y in known:
        held[y].update(grams[i])
    n_good, n = sum(y for _, y in known), len(known)
    base = (n_good + 1) / (n + 2)
    logit = lambda p: math.log(p / (1 - p))

    def word_bin(i, y=None):
        odds = []
        for g in grams[i]:
            up, all_ = held[1][g], held[0][g] + held[1][g]
            if y is not None:
                up, all_ = up - y, all_ - 1
            odds.append(logit((up + q.GRAM_STRENGTH * base) / (all_ + q.GRAM_STRENGTH)) - logit(base))
        score = sum(odds) / len(odds) if odds else 0.0
        return sum(score > e for e in q.EDGES["word_score"])

    counts = Counter()
    for i, y in known:
        for f, b in enumerate([*shapes[i], word_bin(i, y)]):
            counts[f, b, y] += 1

    def evidence(i):
        total = 0.0
        for f, b in enumerate([*shapes[i], word_bin(i)]):
            size = len(q.EDGES[q.FEATURES[f]]) + 1
            total += 0.7 * (math.log((counts[f, b, 1] + 0.5) / (n_good + 0.5 * size)) - math.log((counts[f, b, 0] + 0.5) / (n - n_good + 0.5 * size)))
        return total

    def strength(groups, rate):
        spread = chance = most = 0.0
        for key, (g, m) in groups.items():
            if m > 1:
                p = min(max(rate(key), 1e-3), 1 - 1e-3)
                spread, chance, most = spread + m * (g / m - p) ** 2, chance + p * (1 - p), most + m * p * (1 - p)
        if not most:
            return 10.0
        between = max(0.0, (spread - chance) / max(1e-9, most - chance)) if most > chance else 0.0
        return min(10_000.0, max(1.0, (1 - between) / max(between, 1e-4)))

    hosts, paths = {}, {}
    for i, y in known:
        for groups, key in ((hosts, docs[i][2]), (paths, docs[i][2:4])):
            g, m = groups.get(key, (0, 0))
            groups[key] = (g + y, m + 1)
    s = strength(hosts, lambda _: base)
    host_rate = {h: (g + s * base) / (m + s) for h, (g, m) in hosts.items()}
    s = strength(paths, lambda key: host_rate[key[0]])
    path_rate = {k: (g + s * host_rate[k[0]]) / (m + s) for k, (g, m) in paths.items()}
    for i, _, h, p, _ in docs:
        assert got[i]["evidence"] == pytest.approx(evidence(i)) and got[i]["host_rate"] == pytest.approx(host_rate[h]) and got[i]["path_rate"] == pytest.approx(path_rate.get((h, p), host_rate[h]))
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-evidence(i) - logit(path_rate.get((h, p), host_rate[h])))))


# of any layout and any ids


def test_scores_dont_hang_on_the_layout(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    one, other = ({r["doc_id"]: r["score"] for r in hmm_lm.score(d, held).collect()} for d in (docs.coalesce(1), docs.repartition(7)))
    assert one.keys() == other.keys() and all(other[i] == pytest.approx(x, rel=1e-9) for i, x in one.items())


def test_ids_of_text(spark):
    same = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([("b", same, "en"), ("a", same, "en"), (None, same, "en"), ("c", "und der die das nicht ein wort", "de"), ("c", None, None)], "doc_id string, text string, lang string")
    got = {(r["doc_id"], r["n_shingles"]): r for r in near_dedup.near_duplicates(docs).collect()}
    assert got["b", 6]["component_id"] == "a" and not got["b", 6]["kept"] and got["a", 6]["kept"] and got[None, 6]["kept"]
    found = decontaminate.contamination(docs, docs.selectExpr("doc_id as item_id", "text"), block_bytes=5).collect()
    assert len(found) == 5 and {tuple(r["items"]) for r in found if r["doc_id"] in ("a", "b", None)} == {("a", "b")}
    assert language_id.predict(docs, language_id.fit(docs)).count() == hmm_lm.score(docs, F.lit(False)).count() == packing.pack(docs).count() == 5
    rules = spark.createDataFrame([("x.org", "/", "block"), (None, "/", "block"), ("x.org", None, "allow"), ("x.org", "/y", None)], "host string, path string, verdict string")
    pages = spark.createDataFrame([("p", "http://a.x.org/y"), ("q", None), ("r", "http://x.org/" + "y" * 200_000)], "page_id string, url string").withColumn("host", F.lit("mine"))
    assert sorted((r["page_id"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, rules).collect()) == [("p", "x.org/", "block"), ("q", None, "allow"), ("r", "x.org/", "block")]


def test_blocks_of_items_agree(spark):
    """Rows with a shared id or none are judged each for itself, with one block of items or many."""
    docs = spark.createDataFrame([(1, "a b c d e f g h i"), (1, "none of it"), (None, "x a b c d e f g h"), (None, "q")], "doc_id long, text string")
    items = spark.createDataFrame([(i, t) for i, t in enumerate(("a b c d e f g h", "b c d e f g h i", "q", "z z z"))], "item_id long, text string")
    results = [sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in decontaminate.contamination(docs, items, block_bytes=b).collect()), key=str) for b in (1 << 20, 8)]
    assert results[0] == results[1] and len(results[0]) == 4 and (1, 9, 9, (0, 1)) in results[0]


def test_language_backoff_against_plain():
    """Scores word by word: known words, else the longest known n-grams, shorter ones inside those that are unknown."""
    rng = random.Random(12)
    tables = [Counter({"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 7))): rng.randrange(1, 9) for _ in range(60)}) for _ in range(3)]
    model = language_id._build(["x", "y", "z"], tables, 40)
    words = sorted(set().union(*tables))

    def log(t, keep, table):
        return math.log((table[t] + 0.5) / (sum(table.values()) + 0.5 * (len(keep) + 1)))

    cut = lambda w, n: [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)]
    by_length = {}
    for n in range(1, language_id.LONGEST + 1):
        counted = []
        for t in tables:
            c = Counter()
            for w, k in t.items():
                for g in cut(w, n):
                    c[g] += k
            counted.append(Counter(dict(c.most_common(40))))
        by_length[n] = (counted, sorted(set().union(*counted)))

    def plain(w):
        if w in words:
            return [log(w, words, t) for t in tables]
        found, todo = [], cut(w, min(language_id.LONGEST, len(w) + 2))
        while todo:
            shorter = []
            for g in dict.fromkeys(todo):
                counted, keep = by_length[len(g)]
                if g in keep:
                    found.append([log(g, keep, c) for c in counted])
                elif len(g) > 1:
                    shorter += [g[:-1], g[1:]]
            todo = shorter
        return [sum(x) / max(1, len(found)) for x in zip(*found, strict=True)] if found else [0.0] * 3

    for _ in range(40):
        text = [rng.choice(words) if rng.random() < 0.5 else "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 8))) for _ in range(rng.randrange(1, 12))]
        sums = [sum(x) for x in zip(*map(plain, text), strict=True)]
        best = sums.index(max(sums))
        share = 1 / sum(math.exp((s - sums[best]) / math.sqrt(len(text))) for s in sums)
        lang, score = model.predict(" ".join(text))
        assert score == pytest.approx(share) and (lang == "xyz"[best] or abs(sums["xyz".index(lang)] - sums[best]) < 1e-9)
    assert model.predict("½ ² Ⅷ 12") == ("und", 0.0) and language_id.words_of("été हिन्दी ½") == ["été", "हिन्दी"]


# 9, the pieces


def test_pieces_are_the_text(spark, odd_rows):
    """Cut at words, each piece as long as it says, and all of a text's pieces joined are the text."""
    rng = random.Random(17)
    texts = [r[1] for r in odd_rows] + ["  " + rng.choice(["", "\n"]).join(rng.choice(["é", "ab ", "日本 ", " \t", "🙂\n", "x"]) for _ in range(rng.randrange(60))) for _ in range(60)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    for most in (1, 3, 4096):
        found = {}
        for r in packing.pack(frame, max_tokens=most).collect():
            found.setdefault(r["doc_id"], []).append(r)
        for i, t in enumerate(texts):
            t = t or ""
            rows = sorted(found[i], key=lambda r: r["piece"])
            assert "".join(t[r["begin"] : r["end"]] for r in rows) == t and [r["piece"] for r in rows] == list(range(len(rows)))
            assert [r["n_tokens"] for r in rows] == [len(re.findall(r"[^ \t-\r]+", t[r["begin"] : r["end"]])) + (r is rows[-1]) for r in rows]
            assert all(r["n_tokens"] == most for r in rows[:-1]) and 1 <= rows[-1]["n_tokens"] <= most
