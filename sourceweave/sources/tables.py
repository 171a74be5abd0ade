"""Corpora, claims, evidence bundles and exports, in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceweave.functions import scores, text, vectors

CORPUS = "title string, text string, topic_source string, publish_date string, url string, publisher string, publisher_url string, url_resolved boolean, body_available boolean"
CLAIMS = "claim_id string, claim_text string, query string, verdict string, fact_checker string, rating_label string, factcheck_url string, verdict_date string, topic string, language string, split string, notes string"
BUNDLE = (
    "claim_id string, claim_text string, query string, verdict string, split string, topic string, fact_checker string, factcheck_url string, verdict_date string, summary string, "
    "n_articles int, n_domains int, n_debunk int, retrieval_order string, "
    "articles array<struct<title: string, url: string, publisher: string, domain: string, text: string, body_available: boolean, url_resolved: boolean, pub_date: string, stance: string, similarity: double>>, "
    "similarities array<double>, pairwise array<array<double>>, domains array<string>, claims array<string>, claim_similarities array<array<double>>"
)
ARTICLE = (
    "struct<title: string, snippet: string, url: string, source: string, sourceKey: string, publisher: string, urlResolved: boolean, bodyAvailable: boolean, pubDate: string, sentiment: string, "
    "sentimentScore: double, similarityToSummary: double, coherenceScores: array<double>>"
)
BREAKDOWN = "struct<finalScore: int, semanticScore: double, avgSimilarity: double, domainFactor: double, nDomains: int, domains: array<string>, coherenceFactor: double, sourceCoherence: double>"
TOPIC = f"struct<topic: string, topicName: string, intelligenceSummary: string, summary: string, keywords: array<string>, locations: array<string>, articles: array<{ARTICLE}>, formulaBreakdown: {BREAKDOWN}>"
REPORT = "struct<documents: bigint, resolvedDomainShare: double, knownSourceShare: double, bodyAvailableShare: double, medianBodyChars: int, nDomains: bigint, aggregatorRows: bigint>"
ENVELOPE = f"struct<schemaVersion: int, generatedAt: string, generatedBy: string, qualityReport: {REPORT}, topics: array<{TOPIC}>>"


#: Bytes up to which a table is spread over all cores when it is read.
SPREAD_BYTES = 256 << 20


def scan(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """Columns of a Parquet table. A table of a few row groups is dealt over all cores; a large one is read as it lies.

    The size is that of the files, known before the scan: no more than SPREAD_BYTES are ever shuffled for this.
    """
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)
    size = int(str(rows._jdf.queryExecution().analyzed().collectLeaves().head().stats().sizeInBytes()))
    return rows.repartition(spark.sparkContext.defaultParallelism) if size <= SPREAD_BYTES else rows


def read_csv(spark: SparkSession, path: str, schema: str = CORPUS) -> DataFrame:
    """A table with a header, quoted line breaks and doubled quotes."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_csv(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append or overwrite; control characters are taken out of strings."""
    clean = df.withColumns({c: text.without_controls(F.col(c)) for c, kind in df.dtypes if kind == "string"}) if any(k == "string" for _, k in df.dtypes) else df
    clean.write.mode(mode).csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def resume(topics: DataFrame, done: DataFrame, topic: str = "topic_source") -> DataFrame:
    """Topics that a checkpoint lacks."""
    return topics.join(done.select(topic).distinct(), topic, "left_anti")


def read_bundles(spark: SparkSession, path: str, split: str | None = None, least: int = 2) -> DataFrame:
    """Evidence bundles, a JSON document a file, with ``least`` articles and a summary."""
    rows = spark.read.schema(BUNDLE).json(path, multiLine=True).where((F.col("n_articles") >= least) & (F.coalesce("summary", F.lit("")) != ""))
    return rows.where(F.col("split") == split) if split else rows


def count_articles(bundles: DataFrame) -> DataFrame:
    """Bundles with n_articles, n_domains and n_debunk from their articles."""
    domains = F.array_distinct(F.filter(F.transform("articles", lambda a: a["domain"]), lambda d: d.isNotNull() & (d != "")))
    return bundles.withColumns({"n_articles": F.size("articles"), "n_domains": F.size(domains), "n_debunk": F.size(F.filter("articles", lambda a: a["stance"] == "debunk"))})


def envelope(topics: DataFrame, report: DataFrame, generated_by: str, generated_at: str, order: str = "topic_id") -> DataFrame:
    """One row, json: the export of all topics (a study's, in one document) with the quality report."""
    fields = [c for c in topics.columns if c != order]
    listed = topics.agg(F.transform(F.array_sort(F.collect_list(F.struct(order, F.struct(*fields).alias("t")))), lambda x: x["t"]).alias("topics"))
    names = {"resolvedDomainShare": "resolved_share", "knownSourceShare": "known_share", "bodyAvailableShare": "body_share", "medianBodyChars": "median_body_chars", "nDomains": "n_sources", "aggregatorRows": "aggregator_rows"}
    told = report.select(F.struct("documents", *[F.col(c).alias(n) for n, c in names.items()]).alias("qualityReport"))
    whole = F.struct(F.lit(2).alias("schemaVersion"), F.lit(generated_at).alias("generatedAt"), F.lit(generated_by).alias("generatedBy"), "qualityReport", "topics")
    return listed.crossJoin(F.broadcast(told)).select(F.to_json(whole, {"ignoreNullFields": "false"}).alias("json"))


def write_document(df: DataFrame, path: str) -> None:
    """Write the one document of ``df`` so that readers see the old one or the new one: a temporary file, then a rename."""
    spark = df.sparkSession
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"one document is wanted, there are {len(rows)} or more")
    jvm = spark.sparkContext._jvm
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf) if "://" in path or path.startswith("file:") else jvm.org.apache.hadoop.fs.FileContext.getFileContext(conf)
    files = part.getFileSystem(conf)
    try:
        out = files.create(part, True)
        out.write(bytearray(rows[0][0].encode("utf-8")))
        out.close()
        overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(part, target, overwrite)
    finally:
        if files.exists(part):
            files.delete(part, False)


def read_export(documents: DataFrame, json: str = "json") -> DataFrame:
    """(ord, topic, ...): topics of exports, in their order, in the current form or as a bare list.

    A missing breakdown is computed again, but only where every article has a similarity.
    """
    bare = F.ltrim(F.col(json)).startswith("[")
    listed = F.when(bare, F.from_json(json, f"array<{TOPIC}>")).otherwise(F.from_json(json, ENVELOPE)["topics"])
    rows = documents.select(F.posexplode(listed).alias("ord", "t")).select("ord", "t.*")
    articles = F.coalesce("articles", F.array().cast(f"array<{ARTICLE}>"))
    sims = F.transform(articles, lambda a: a["similarityToSummary"])
    upper = F.filter(vectors.triangle_of_others(F.transform(articles, lambda a: F.coalesce(a["coherenceScores"], F.array().cast("array<double>")))), lambda v: v.isNotNull())
    parts = scores.score_arrays(sims, F.transform(articles, lambda a: a["source"]), upper)
    again = F.struct(
        parts["final_score"].alias("finalScore"), parts["semantic_score"].alias("semanticScore"), parts["avg_similarity"].alias("avgSimilarity"), parts["source_factor"].alias("domainFactor"),
        parts["n_sources"].alias("nDomains"), parts["sources"].alias("domains"), parts["coherence_factor"].alias("coherenceFactor"), parts["source_coherence"].alias("sourceCoherence"),
    )
    proven = (F.size(articles) > 0) & F.forall(sims, lambda s: s.isNotNull())
    return rows.select(
        "ord", F.coalesce("topic", F.lit("")).alias("topic"), "topicName", F.coalesce("intelligenceSummary", "summary", F.lit("")).alias("intelligenceSummary"),
        F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), F.coalesce("locations", F.array().cast("array<string>")).alias("locations"), articles.alias("articles"),
        F.coalesce("formulaBreakdown", F.when(proven, again.cast(BREAKDOWN))).alias("formulaBreakdown"),
    )


def result_table(scored: DataFrame, rows: str = "method", columns: str = "claim_id", value: str = "score") -> DataFrame:
    """A wide table: a row a method, a column a claim."""
    return scored.groupBy(rows).pivot(columns).agg(F.first(value))


def markdown(df: DataFrame, columns: list[str] | None = None) -> str:
    """A small result table as Markdown."""
    shown = columns or df.columns
    lines = ["| " + " | ".join(shown) + " |", "|" + "---|" * len(shown)]
    return "\n".join([*lines, *("| " + " | ".join("" if r[c] is None else str(r[c]) for c in shown) + " |" for r in df.select(*shown).collect())])
