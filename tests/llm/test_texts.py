"""Language, scoring, extraction, licences and the pipeline."""

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF_DIR, WORDS

from spendguard.llm.extraction import default_weight, extract, fit_weights, main_text, page_items, page_tokens
from spendguard.llm.language import fit_languages, identify, mixture
from spendguard.llm.language_model import score_texts, seat
from spendguard.llm.licenses import LICENSES, known_licenses, scan

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_languages(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    held = "crc32(cast(doc_id as string)) % 4 = 2"
    model = fit_languages(docs.where(f"not ({held})"))
    out = identify(docs.where(held), model, carry=["lang"])
    assert out.where("lang = lang_pred").count() >= 0.97 * out.count()
    got = {r["doc_id"]: r for r in identify(odd_docs, model).collect()}
    assert {i for i, r in got.items() if r["lang_pred"] == "und"} == {2, 3, 4, 5}
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert identify(no_docs, model).count() == 0
    assert {r["lang_pred"] for r in identify(odd_docs, fit_languages(no_docs)).collect()} == {"und"}


def test_mixtures_find_the_set_of_languages():
    rng = np.random.default_rng(1)
    # Rows 0 and 1 have one language each, row 2 has two in equal parts.
    truth = np.concatenate([np.zeros(60), np.ones(60), rng.permutation([0] * 30 + [2] * 30)]).astype(int)
    scores = np.full((180, 3), -12.0)
    scores[np.arange(180), truth] = -8.0
    best, sure = mixture(scores.astype(np.float32), np.repeat([0, 1, 2], 60), 4)
    assert best[0] == 0 and best[1] == 1 and best[2] in (0, 2) and best[3] == -1
    assert sure[0] > 0.99 and 0.4 < sure[2] < 0.6 and sure[3] == 0


def test_base_scores_and_counts(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    held = zlib.crc32
    rows = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {i: [*_WORD.findall(t.translate(lower)), "\n"] for i, t in rows.items()}
    out = {i: held(str(i).encode()) % 7 == 2 for i in rows}
    counts = Counter(w for i, ws in tokens.items() if not out[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    from spendguard.llm.language import held_out

    got = score_texts(docs, held_out("doc_id", 7), contexts=200, tokens_per_bucket=20_000).collect()
    assert len(got) == len(rows)
    for r in got:
        ws = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (out[r["doc_id"]], len(ws), n)
        assert r["n_known"] == sum(w in counts for w in ws)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), abs=1e-6)
    better = [r["score"] > r["base_score"] for r in got if r["held_out"]]
    assert sum(better) > 0.8 * len(better)
    few = score_texts(odd_docs, contexts=5).collect()
    assert len(few) == odd_docs.count() and all(r["score"] < 0 for r in few)
    assert score_texts(no_docs, contexts=5).count() == 0


def test_probabilities_sum_to_one(spark):
    """With one restaurant for all words, sums over one more word give the probability of the end."""
    train = [" ".join(WORDS[(i * j) % 7] for j in range(i % 9)) for i in range(60)]
    types = sorted({w for t in train for w in t.split()}) + ["unknown"]
    probes = ["", *types, *[f"{types[0]} {w}" for w in types]]
    rows = [*enumerate(train), *[(1000 + i, p) for i, p in enumerate(probes)]]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: 10 ** r["score"] for r in score_texts(df, F.col("doc_id") >= 1000, contexts=0).collect()}
    p = {text: got[1000 + i] for i, text in enumerate(probes)}
    end = 1 - sum(p[f"{types[0]} {w}"] for w in types) / p[types[0]]
    assert 0 < end < 1
    assert p[""] + sum(p[w] for w in types) / end == pytest.approx(1, abs=1e-6)


def test_seating_has_the_expected_number_of_tables():
    counts, weight = np.full(4000, 50), np.full(4000, 3.0)
    tables = seat(counts, weight, 0.0, np.random.default_rng(0))
    want = sum(3 / (3 + n) for n in range(50))  # a Chinese restaurant without discount
    assert tables.mean() == pytest.approx(want, rel=0.03) and tables.min() >= 1
    assert list(seat(np.array([0, 1]), np.ones(2), 0.5, np.random.default_rng(0))) == [0, 1]
    large = seat(np.full(200, 20_000), np.full(200, 3.0), 0.0, np.random.default_rng(1))
    assert large.mean() == pytest.approx(sum(3 / (3 + n) for n in range(20_000)), rel=0.05)


PAGE = """<html><head><title>Title</title><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/x">Home page</a></li><li><a title="a>b" href=y>More</a></li></ul></nav>
<div class="ad">Buy this now, it is cheap and good</div>
<article><h1>Head &amp; line</h1><p>First   words&nbsp;of <b>bold</b>ness here.<p>Second &lt;part&gt;<script>x()</script> of it
<aside>See also this other page</aside><form><input><button>Send</button></form>
<section class="comments"><p>Nice post, thank you</p></section></article><footer>Contact us by mail</footer></body></html>"""


def test_extraction(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    weights = fit_weights(pages)
    assert all((w > 0) == f.startswith("in ") for f, w in weights.items())
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<div><nav>a b c</nav></div>"), (1, "u", PAGE), (None, "v", "<p>only text")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text", "1 as n_chars")
    got = extract(df, weights).collect()
    assert [r["text"] for r in got if r["page_id"] == 1] == ["Head & line\nFirst words of boldness here.\nSecond <part> of it"] * 2
    assert {r["text"] for r in got if r["page_id"] in (2, 3, 4)} == {""}
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert extract(df.where("false"), fit_weights(df.where("false"))).count() == 0
    assert main_text("<p>" + "word " * 200_000, {}).count("word") == 200_000


def test_licences(spark, odd_docs, no_docs):
    known = known_licenses(spark)
    rows = [(1, "Copyright (c) 2020 Someone\n\n" + LICENSES[0][1].upper()), (2, LICENSES[1][1].replace(",", " ;")), (3, LICENSES[0][1] + " and more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["license_id"] for r in scan(docs, known).collect()} == {1: "MIT", 2: "ISC", 3: None}
    odd = scan(odd_docs, known)
    assert odd.count() == odd_docs.count() and odd.where("license_id is not null").isEmpty()
    assert scan(no_docs, known).count() == 0


def test_registered_licence_query_equals_sql(spark):
    from compare import differences, open_tables

    from spendguard.llm.queries import QUERIES, SQL

    name = "op9_license_scan"
    assert differences(spark, open_tables(SF_DIR), SF_DIR, name, QUERIES[name], SQL[name]) is None


def test_pipeline_stages(spark, odd_docs, no_docs):
    import corpus_pipeline as pipeline

    docs = odd_docs.select("doc_id", "text", "lang", "source", "size")
    stage = dict(pipeline.STAGES)
    kept = stage["language_id"](spark, docs, SF_DIR)
    assert kept.columns == docs.columns and sorted(r[0] or 0 for r in kept.select("doc_id").collect()) == [0, 1, 1, 6, 7, 8, 9]
    single = stage["near_duplicates"](spark, kept, SF_DIR)
    assert sorted(r[0] or 0 for r in single.select("doc_id").collect()) == [0, 1, 6, 8, 9]
    mixed = stage["mixing"](spark, single, SF_DIR)
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id").count().where("count > 2").isEmpty()
    packed = stage["packing"](spark, mixed, SF_DIR)
    assert packed.where("piece = 0").count() == mixed.count()
    for _, run in pipeline.STAGES:
        assert run(spark, no_docs.select(*docs.columns), SF_DIR).count() == 0


def test_every_context_has_a_restaurant(spark):
    """Rare contexts predict apart from each other, and the partitioning of the rows does not matter."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    frequent = [f"f{i}" for i in range(40)]
    pairs = [(f"rare{i}", f"next{i}") for i in range(300)]
    train = [" ".join([*rng.choice(frequent, 30), *pairs[i % 300], *rng.choice(frequent, 5)]) for i in range(1500)]
    probes = [(f"rare{i} next{i}", f"rare{i} next{(i + 7) % 300}") for i in range(0, 300, 15)]
    rows = [*enumerate(train), *[(10_000 + 2 * i + j, p[j]) for i, p in enumerate(probes) for j in (0, 1)]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    results = []
    for parts in (1, 7):
        scored = score_texts(df.repartition(parts, "text"), F.col("doc_id") >= 10_000, hot_words=20, tokens_per_bucket=10_000)
        results.append({r["doc_id"]: (r["n_known"], r["score"]) for r in scored.collect()})
    assert results[0] == results[1]
    right, wrong = ([results[0][10_000 + 2 * i + j][1] for i in range(len(probes))] for j in (0, 1))
    assert min(np.array(right) - np.array(wrong)) > 1


def test_names_do_not_drop_whole_pages():
    text = "one two three four five six"
    for page in (f"<body class='has-sidebar'><p>{text}", f"<body class='search'><p>{text}", f"<div id='page' class='no-sidebar'><p>{text}</div>", f"<article class='post comment-open'><p>{text}</article>"):
        assert main_text(page, {}) == text
    assert main_text(f"<div class='box Sidebar'><p>{text}</div>", {}) == ""
    menu = "<div class='menu'>" + "<p><a>x</a></p>" * 50 + "</div>"
    assert main_text(f"<p>{text}</p>{menu}<p>{text}", {}) == f"{text}\n{text}"


def test_pipeline_keeps_different_texts_of_one_id(spark):
    import corpus_pipeline as pipeline

    one, two = (" ".join(f"{w}{i}" for i in range(40)) for w in ("red", "blue"))
    rows = [(1, one), (1, two), (None, one), (2, two + " more"), (3, ""), (3, None), (None, "third text of its own")]
    docs = spark.createDataFrame([(i, t, None, None) for i, t in rows], "doc_id long, text string, lang string, source string")
    single = pipeline.near_duplicates(spark, docs, SF_DIR).collect()
    assert sorted(((r["doc_id"] or 0, r["text"] or "") for r in single)) == sorted(
        [(1, one), (1, two), (3, ""), (3, ""), (0, "third text of its own")]
    )
    assert pipeline.language_id(spark, docs, SF_DIR).count() == 5
    mixed = pipeline.mixing(spark, docs, SF_DIR)
    assert {r["text"] for r in mixed.collect()} <= {t for _, t in rows} and mixed.columns == docs.columns


@pytest.mark.parametrize(
    "unit, tail",
    [("<a ", ""), ("<a ", "\""), ("<" + "a" * 50, ""), ("<i></b>", ""), ("<a \"", ""), ("<a '\">", "\""), ("<b><p></p>", "")],
)
def test_broken_markup_takes_linear_time(unit, tail):
    def seconds(n):
        page = unit * (n // len(unit)) + tail
        start = time.process_time()
        main_text(page, {})
        return time.process_time() - start

    assert seconds(800_000) < 6 * seconds(200_000) + 1


def test_tokens_of_unclosed_tags_and_quotes():
    kinds = lambda page: [(k, n or t) for k, n, _, t in page_tokens(page)]
    assert kinds('a<b title="x > y">c</b>') == [("text", "a"), ("open", "b"), ("text", "c"), ("close", "b")]
    assert kinds('a<b title="x>c') == [("text", "a"), ("text", "c")]  # the quote never ends: the tag ends at its `>`
    assert kinds("1 < 2 <p") == [("text", "1 "), ("text", "< 2 ")]
    assert kinds("<!-- <p> -->x<!-- y") == [("text", "x")]
    assert kinds("<script>if (a < b) '</p>'</SCRIPT >z<style>q") == [("opaque", "script"), ("text", "z"), ("opaque", "style")]


def test_compound_class_names_of_asides():
    body = "word " * 40
    for name in ("post-comments", "related-posts", "cookie-banner", "newsletterSignup", "js_share_box"):
        assert main_text(f"<article><p>{body}</p><div class='{name}'><p>{body}</p></div></article>", {}) == body.strip()
    for name in ("no-sidebar", "content--with-sidebar", "shareholder", "recommended"):
        assert main_text(f"<div class='{name}'><p>{body}</p></div>", {}) == body.strip()


def test_content_after_a_table_without_learned_weights():
    cells = "".join(f"<tr><td>{i}</td><td>x</td></tr>" for i in range(60))
    text = main_text(f"<p>{'first ' * 30}</p><table><tbody>{cells}</tbody></table><p>{'last ' * 30}</p>", {})
    assert text.startswith("first") and text.endswith("last") and "59" in text


def test_best_region_against_all_regions():
    rng = random.Random(3)
    for _ in range(60):
        parts = ["".join(f"<{t}>" for t in rng.choices(["div", "p", "a", "hr"], k=rng.randrange(5))) + f"w{i} " * rng.randrange(4) for i in range(9)]
        page = "".join(parts)
        items = page_items(page)
        gain = [default_weight(f) * (n if t is not None else 1) for f, n, _, t, _, _ in items]
        sums = {(i, j): sum(gain[i:j]) for i in range(len(items)) for j in range(i + 1, len(items) + 1)}
        best = max(sums.values(), default=0)
        found = main_text(page, {})
        if best <= 1e-9:
            assert found == ""
            continue
        # The text is that of the blocks of some region with the highest sum.
        texts = set()
        for (i, j), total in sums.items():
            if total > best - 1e-9:
                blocks = {}
                for f, n, b, t, _, _ in items:
                    if t is not None and items[i][2] <= b <= items[j - 1][2]:
                        blocks.setdefault(b, []).append(t)
                texts.add("\n".join(x for x in (" ".join("".join(p).split()) for p in blocks.values()) if x))
        assert found in texts
