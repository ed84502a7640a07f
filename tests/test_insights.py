import json

import pytest
from pyspark.ml.feature import HashingTF, NGram
from pyspark.sql import functions as F

from themeloom.operators import annotate, language, quotes, report, sentiment
from themeloom.plans import flow, tables
from themeloom.sources import adapters, sinks


def pool_frame(spark, rows):
    return spark.createDataFrame(
        rows, "id string, seq long, source string, cluster_id int, rating double, sentiment double, "
              "is_near_dup boolean, from_noise boolean, centroid_cos double, text string, timestamp timestamp")


def row(seq, source="a", cluster=0, rating=None, mood=0.0, dup=False, noise=False, cos=0.5):
    return (f"{source}:{seq}", seq, source, cluster, rating, mood, dup, noise, cos, f"text {seq}", None)


def test_quote_pool_rules(spark):
    five = [row(i, dup=i >= 5) for i in range(9)]
    four = [row(20 + i, cluster=1, dup=i >= 4) for i in range(9)]
    stragglers = [row(40 + i, cluster=2, noise=i >= 5) for i in range(8)]
    few_core = [row(60 + i, cluster=3, dup=i >= 6, noise=i >= 3) for i in range(10)]
    got = quotes.quote_pool(pool_frame(spark, five + four + stragglers + few_core)).groupBy("cluster_id").count()
    assert {r.cluster_id: r["count"] for r in got.collect()} == {0: 5, 1: 9, 2: 5, 3: 6}


def expected_sample(rows, limit=15):
    prior = lambda r: 0.7 * (5 - r[4]) / 4 + 0.3 * max(0, -r[5]) if r[4] is not None else max(0, -r[5])
    near = sorted(rows, key=lambda r: (-r[8], r[1]))[: max(3, limit // 2)]
    chosen = list(near)
    for r in sorted(rows, key=lambda r: (-prior(r), r[1])):
        if len(chosen) >= limit - 2:
            break
        if r not in chosen:
            chosen.append(r)
    for source in sorted({r[2] for r in rows}):
        if not any(r[2] == source for r in chosen):
            chosen.append(min((r for r in rows if r[2] == source), key=lambda r: r[1]))
    return [r[0] for r in chosen[:limit]]


@pytest.mark.parametrize("n", [2, 9, 14, 60])
def test_quote_sample_tiers(spark, n):
    rows = [row(i, source="ab"[i % 2], rating=float(i % 5 + 1) if i % 3 else None, mood=((i * 37) % 19) / 10 - 0.9,
                cos=((i * 53) % 101) / 101) for i in range(n)]
    rows += [row(100 + i, source=f"rare{i}", rating=5.0, cos=-1.0 - i) for i in range(4)]
    got = quotes.quote_sample(pool_frame(spark, rows)).orderBy("pos").collect()
    assert [r.id for r in got] == expected_sample(rows)


def test_quote_lines_and_prompt_key(spark):
    rows = [row(1, rating=4.0), row(2, mood=-0.5)]
    df = pool_frame(spark, rows).withColumn(
        "timestamp", F.when(F.col("seq") == 1, F.lit("2024-03-04 05:06:07").cast("timestamp")))
    sample = quotes.quote_sample(df)
    block = quotes.prompt_blocks(sample).head()
    assert block.quotes_block.split("\n") == ["[a:1] (a | rating: 4/5 | 2024-03-04) text 1", "[a:2] (a) text 2"]
    summary = spark.sql("select 0 as cluster_id, 2L as n_items, map('a', 2L) as sources")
    one = quotes.cluster_prompts(quotes.prompt_blocks(sample), summary).head()
    other = quotes.cluster_prompts(quotes.prompt_blocks(sample), summary, model="other").head()
    assert "a: 2" in one.user_prompt and len(one.prompt_key) == 64 and one.prompt_key != other.prompt_key


GOOD = {
    "theme_name": "Login", "summary": "s", "root_causes": ["r"], "severity": 4, "severity_rationale": "x",
    "recommended_actions": [{"action": "a", "effort": "low", "rationale": "b"}], "evidence_quote_ids": ["a:1"],
}


def test_annotation_validation(spark):
    bad_effort = [{"action": "a", "effort": "huge", "rationale": "b"}]
    cases = [
        (GOOD, True), ({**GOOD, "severity": 6}, False), ({**GOOD, "severity": 0}, False),
        ({**GOOD, "recommended_actions": []}, False), ({**GOOD, "recommended_actions": GOOD["recommended_actions"] * 4}, False),
        ({**GOOD, "recommended_actions": bad_effort}, False), ({k: v for k, v in GOOD.items() if k != "summary"}, False),
        ({**GOOD, "evidence_quote_ids": []}, True),
    ]
    rows = [(i, json.dumps(c)) for i, (c, _) in enumerate(cases)] + [(99, "not json"), (100, None)]
    got = {r.cluster_id: r.valid for r in annotate.parse(spark.createDataFrame(rows, "cluster_id int, raw string")).collect()}
    assert [got[i] for i in range(len(cases))] == [ok for _, ok in cases]
    assert not got[99] and not got[100]


def verify(spark, cited, members=("a:1", "a:2", "b:12")):
    c = spark.createDataFrame([(0, list(cited))], "cluster_id int, cited_ids array<string>")
    m = spark.createDataFrame([(0, x) for x in members], "cluster_id int, id string")
    r = annotate.verify_citations(c, m).head()
    return r.citation_check_passed, r.citation_check_detail, r.resolved_ids


def test_citations(spark):
    assert verify(spark, ["b:12", "a:1"]) == (True, "all 2 cited quote ids verified as cluster members", ["b:12", "a:1"])
    assert verify(spark, ["1"])[::2] == (True, ["a:1"])
    ok, detail, ids = verify(spark, ["2"])  # ends two ids
    assert not ok and ids == ["2"]
    ok, detail, ids = verify(spark, ["z:9", "a:1", "y", "x", "w"])
    assert not ok and detail == "LLM cited 4 unknown quote id(s): ['w', 'x', 'y']" and ids[1] == "a:1"
    assert verify(spark, []) == (False, "LLM cited no evidence quotes", [])


def test_annotation_reuse_and_failures(spark):
    quote = "array(named_struct('id','a:1','text','login page fails','source','a','timestamp','','rating',1d,'sentiment',-0.5d))"
    prompts = spark.sql(f"select cast(id as int) cluster_id, concat('k', id) prompt_key, {quote} quotes from range(3)")
    known = spark.createDataFrame([("k0", json.dumps(GOOD))], "prompt_key string, raw string")

    def flaky(r):
        if r["cluster_id"] == 2:
            raise RuntimeError("down")
        return annotate.extractive(r)

    answers, fresh = annotate.annotate_with_reuse(prompts, known, flaky)
    got = {r.cluster_id: r for r in answers.collect()}
    assert got[0].cached and not got[1].cached and got[2].raw is None and got[2].error == "down"
    assert [r.prompt_key for r in fresh.collect()] == ["k1"]
    assert json.loads(got[1].raw)["evidence_quote_ids"] == ["a:1"]


def test_sentiment_rules(spark):
    lex = spark.createDataFrame([("good", 1.9), ("bad", -2.5)], "word string, valence double")
    texts = ["good app", "not good app", "very good app", "GOOD app", "good but bad", "good!!!", "plain app", "really? good?"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text_clean string")
    got = [r.sentiment for r in sentiment.add_sentiment(df, lex).orderBy("id").collect()]
    norm = lambda s: round(s / (s * s + 15) ** 0.5, 4)
    want = [1.9, -0.74 * 1.9, 1.9 + 0.293, 1.9 + 0.733, 0.5 * 1.9 + 1.5 * -2.5, 1.9 + 3 * 0.292, 0.0, 1.9 + 0.293 + 0.36]
    assert got == pytest.approx([norm(s) for s in want], abs=1e-4)


def test_language_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs)
    out = language.add_language(docs.withColumnRenamed("lang", "given"), model, "text")
    assert out.filter("given = lang").count() / docs.count() > 0.95
    odd = language.add_language(spark.createDataFrame([("1234 !!",)], "text string"), model, "text")
    assert odd.head().lang is None


def insight(cluster, priority, badge):
    return (cluster, priority, {"badge": badge}, {"theme_name": f"T{cluster}"})


def test_fallback_summary_prefers_solid_evidence(spark):
    schema = "cluster_id int, priority_score double, confidence struct<badge:string>, analysis struct<theme_name:string>"
    rows = [insight(1, 0.9, "low_sample"), insight(2, 0.5, "ok"), insight(3, 0.7, "ok")]
    got = report.fallback_summary(spark.createDataFrame(rows, schema)).head()
    assert got.suggested_focus == ["T3", "T2"] and got.headline == "Top issue: T3"
    weak = report.fallback_summary(spark.createDataFrame(rows[:1], schema)).head()
    assert weak.suggested_focus == ["T1"]
    assert report.fallback_summary(spark.createDataFrame([], schema)).head().headline == "No themes"
    assert report.fallback_summary(spark.createDataFrame(rows, schema), prefer_ok=False).head().suggested_focus[0] == "T1"


def test_whole_flow(spark, tiny, tmp_path):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = adapters.upload(docs, "doc_id", "App review", "text")
    corpus, stats = flow.prepare(rows, tables.lexicon(spark), flow.FlowSettings(min_cluster_size=4, near_dup_cosine=0.9))
    assert stats.head().output == corpus.count() + stats_copies(docs, stats)
    assert {"is_near_dup", "cluster_id", "from_noise", "pca_x", "pca_y", "sentiment", "age_days", "centroid_cos"} <= set(corpus.columns)
    corpus, insights = flow.analyse(corpus)
    found = insights.collect()
    assert found and all(i.citation_check_passed for i in found)
    assert all(i.confidence.n_items >= 4 for i in found)
    meta = flow.run_record(stats, corpus, flow.FlowSettings(), "2024-01-01", 1.25, insights).head()
    assert meta.clean.output == stats.head().output and meta.clusters_analysed == len(found)
    assert json.loads(meta.config)["score"]["half_life_days"] == 90.0
    summary = report.fallback_summary(insights)
    header = report.report_header(summary, corpus.count(), "2024-01-01")
    assert f"from {corpus.count()} feedback items_" in header.head().block
    sinks.write_report(header.unionByName(report.report_blocks(insights)), str(tmp_path / "report"))
    sinks.write_insights(insights, str(tmp_path / "insights"))
    assert spark.read.text(str(tmp_path / "report")).filter("value like '## 1. %'").count() == 1
    with pytest.raises(ValueError, match="usable rows"):
        flow.prepare(rows.limit(5), tables.lexicon(spark))


def stats_copies(docs, stats):
    from themeloom.operators import cleaning

    kept = cleaning.keep_clean(cleaning.tag_drops(cleaning.add_clean_text(docs)))
    return cleaning.exact_copy_count(kept).head().n_copies


def test_hashed_trigrams_equal_those_of_spark(spark, monkeypatch):
    words = ["the cat", "Über-Maß 12", "x", "", "a￿b", "\U00010330\U00010331 gothic", "naïve ǅ İstanbul", "日本語 テキスト"]
    many = ["".join(chr(0x4E00 + 7 * i + j) for j in range(200)) for i in range(3)]
    texts = words + many + ["abc " * 50] * 3 + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "seq int, text string").coalesce(1)
    plain = F.regexp_replace(F.lower("text"), r"[^\p{L}]+", "_")
    chars = df.filter("text IS NOT NULL").withColumn("_chars", F.split(F.concat(F.lit("_"), plain, F.lit("_")), ""))
    grams = NGram(n=3, inputCol="_chars", outputCol="_grams").transform(chars)
    for n_features in (1 << 14, 1000):
        want = HashingTF(inputCol="_grams", outputCol="_tf", numFeatures=n_features).transform(grams)
        want = {r.seq: r._tf for r in want.collect()} | {len(texts) - 1: None}
        for chars_at_once in (1 << 20, 3):
            monkeypatch.setattr(language, "CHARS", chars_at_once)
            got = {r.seq: r._tf for r in language._with_features(df, "text", n_features).collect()}
            assert got == want


def test_trigram_features_are_not_made_as_strings(spark):
    df = spark.createDataFrame([("the cat", "en"), ("die Katze", "de")], "text string, lang string")
    found = language.add_language(df, language.train(df), "text")
    assert sorted(r.lang for r in found.collect()) == ["de", "en"]
    plan = found.filter("lang = 'en'")._jdf.queryExecution().executedPlan().toString()
    assert "split(" not in plan and plan.count("ArrowEvalPython") == 1
