"""The registered queries: every operator on the given tables, or on sources built from them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import generate, metrics, rewrite, score
from codeloom.operators.diff import change_hunks, changed_lines, removed_lines
from codeloom.operators.lines import assemble_files, cluster_files, explode_lines
from codeloom.operators.revisions import (
    as_of_snapshot,
    change_pairs,
    commit_range,
    file_changes,
    filter_supported,
    modified_paths,
    overlay_snapshot,
    path_lives,
    previous_revision,
    with_language,
)
from codeloom.operators.skew import salted_join
from codeloom.operators.structure import (
    changed_functions,
    comment_lines,
    comment_ranges,
    doc_change_lines,
    doc_slots,
    doc_spans,
    function_doc_pairs,
    function_spans,
    functions,
    logical_lines,
)
from codeloom.plans.replay import replay_history, score_replay
from codeloom.plans.update import comment_pairs, function_docs_changed, update_docs
from codeloom.session import materialize, scratch_dir
from codeloom.sources.built import built_sources
from codeloom.sources.results import append_run, load_attempts, load_scores, replace_run
from codeloom.sources.snapshots import load_snapshot, read_snapshot, write_files, write_snapshot
from codeloom.streaming.changes import stream_changed_functions, stream_changed_lines
from codeloom.streaming.ratio import stream_success_ratio

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Revisions: a conversation is a file, a turn a revision.


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(
        "cast(conv_id AS string) AS path", "turn AS rev", "text AS content"
    )


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return previous_revision(turns(spark, sf_dir))


@query
def conv_previous(spark, sf_dir):
    return turn_pairs(spark, sf_dir).selectExpr(
        "cast(path AS bigint) AS conv_id", "rev AS turn", "prev_rev", "md5(old_content) AS old_md5", "md5(new_content) AS new_md5"
    )


@query
def conv_as_of(spark, sf_dir):
    return as_of_snapshot(turns(spark, sf_dir), 3).selectExpr(
        "cast(path AS bigint) AS conv_id", "rev AS turn", "md5(content) AS content_md5"
    )


@query
def conv_commit_range(spark, sf_dir):
    commits = turns(spark, sf_dir).select("rev").distinct()
    return commit_range(commits, 1, 5).select("rev", "idx", "is_base")


def _by_conversation(rows: DataFrame) -> DataFrame:
    return rows.withColumn("path", F.col("path").cast("bigint")).withColumnsRenamed({"path": "conv_id", "rev": "turn"})


@query
def conv_changed_lines(spark, sf_dir):
    return _by_conversation(changed_lines(turn_pairs(spark, sf_dir), "multiset"))


@query
def conv_changed_counts(spark, sf_dir):
    lines = changed_lines(turn_pairs(spark, sf_dir), "multiset")
    return _by_conversation(lines.groupBy("path", "rev").agg(F.count(F.lit(1)).alias("n_changed")))


@query
def conv_removed_lines(spark, sf_dir):
    return _by_conversation(removed_lines(turn_pairs(spark, sf_dir), "multiset"))


@query
def conv_hunks(spark, sf_dir):
    return _by_conversation(change_hunks(changed_lines(turn_pairs(spark, sf_dir), "multiset")))


# Sources built from the part table.


def sources(spark: SparkSession, sf_dir: str, *revs: int) -> DataFrame:
    return built_sources(table(spark, sf_dir, "part"), revs or (0, 1, 2, 3))


def python_sources(spark: SparkSession, sf_dir: str, *revs: int) -> DataFrame:
    return filter_supported(sources(spark, sf_dir, *revs)).where("language = 'python'").drop("language")


def step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python files changed from revision 0 to 1, written once: several operators read them."""
    old, new = python_sources(spark, sf_dir, 0), python_sources(spark, sf_dir, 1)
    return materialize(change_pairs(file_changes(old, new), 1), "pairs")


def step_functions(pairs: DataFrame) -> DataFrame:
    return changed_functions(functions(cluster_files(rewrite.new_side(pairs))), changed_lines(pairs))


def content_md5(files: DataFrame) -> DataFrame:
    return files.withColumn("content_md5", F.md5("content")).drop("content")


@query
def src_language(spark, sf_dir):
    return with_language(sources(spark, sf_dir)).select("path", "rev", "language")


@query
def src_supported(spark, sf_dir):
    return filter_supported(sources(spark, sf_dir), exclude=["economy/m0/brand_2.py"]).select("path", "rev", "language")


@query
def src_lines(spark, sf_dir):
    return explode_lines(sources(spark, sf_dir))


@query
def src_round_trip(spark, sf_dir):
    return content_md5(assemble_files(explode_lines(sources(spark, sf_dir), ends=True)))


@query
def src_file_changes(spark, sf_dir):
    changes = file_changes(sources(spark, sf_dir, 0), sources(spark, sf_dir, 1))
    return changes.selectExpr("path", "status", "md5(old_content) AS old_md5", "md5(new_content) AS new_md5")


@query
def src_overlay(spark, sf_dir):
    patch = sources(spark, sf_dir, 1).where(F.col("path").endswith(".py"))
    return content_md5(overlay_snapshot(sources(spark, sf_dir, 0), patch))


@query
def src_modified_paths(spark, sf_dir):
    pairs = previous_revision(sources(spark, sf_dir)).where("rev BETWEEN 1 AND 2 AND NOT (old_content <=> new_content)")
    return modified_paths(pairs)


@query
def src_logical_lines(spark, sf_dir):
    return logical_lines(python_sources(spark, sf_dir))


@query
def src_function_spans(spark, sf_dir):
    return function_spans(python_sources(spark, sf_dir))


@query
def src_doc_spans(spark, sf_dir):
    return doc_spans(functions(python_sources(spark, sf_dir)))


@query
def src_comment_lines(spark, sf_dir):
    return comment_lines(functions(python_sources(spark, sf_dir)))


@query
def src_comment_ranges(spark, sf_dir):
    return comment_ranges(functions(python_sources(spark, sf_dir)))


@query
def src_doc_pairs(spark, sf_dir):
    return function_doc_pairs(functions(python_sources(spark, sf_dir)))


@query
def src_changed_lines(spark, sf_dir):
    return changed_lines(step(spark, sf_dir))


@query
def src_removed_lines(spark, sf_dir):
    return removed_lines(step(spark, sf_dir))


@query
def src_changed_functions(spark, sf_dir):
    return step_functions(step(spark, sf_dir)).select("path", "rev", "fn_id", "name")


@query
def src_changed_history(spark, sf_dir):
    pairs = materialize(previous_revision(python_sources(spark, sf_dir)), "pairs")
    changed = changed_functions(functions(cluster_files(rewrite.new_side(pairs))), changed_lines(pairs))
    return changed.select("path", "rev", "name")


@query
def src_docs_changed(spark, sf_dir):
    return function_docs_changed(step(spark, sf_dir))


@query
def src_doc_change_lines(spark, sf_dir):
    pairs = step(spark, sf_dir)
    old = rewrite.old_side(pairs)
    lines = doc_change_lines(changed_functions(functions(cluster_files(old)), removed_lines(pairs)))
    return lines.join(explode_lines(old), ["path", "rev", "ln"]).select("path", "rev", "ln", "text")


def step_slots(pairs: DataFrame) -> DataFrame:
    new = cluster_files(rewrite.new_side(pairs))
    return doc_slots(changed_functions(functions(new), changed_lines(pairs)), new)


@query
def src_doc_slots(spark, sf_dir):
    return step_slots(step(spark, sf_dir)).select("path", "rev", "name", "code", "slot_ln", "replace_to_ln", "slot_col")


@query
def src_strip(spark, sf_dir):
    return content_md5(rewrite.strip_comments(python_sources(spark, sf_dir)))


@query
def src_strip_changed(spark, sf_dir):
    return content_md5(rewrite.strip_changed_comments(step(spark, sf_dir)))


@query
def src_restore(spark, sf_dir):
    pairs = step(spark, sf_dir)
    cleaned = rewrite.strip_changed_comments(pairs).selectExpr("path", "rev", "content AS new_content")
    both = materialize(pairs.drop("new_content").join(cleaned, ["path", "rev"]), "cleaned")
    return content_md5(rewrite.restore_comments(both))


# Generation with a stand-in for the model: what it answers depends on the length of the prompt only.


def stand_in() -> Callable[[], generate.TextModel]:
    def factory() -> generate.TextModel:
        def answer(prompts: list[str]) -> list[str]:
            return [
                f'"""Doc of {len(p)} signs."""' if len(p) % 4 else f"def f{len(p)}(): pass" for p in prompts
            ]

        return answer

    return factory


TEMPLATE = "Document this {program_language} function:\n{code}\n"


def step_prompts(pairs: DataFrame) -> DataFrame:
    return generate.render_prompt(step_slots(pairs).withColumn("language", F.lit("python")), TEMPLATE)


@query
def src_prompt(spark, sf_dir):
    return step_prompts(step(spark, sf_dir)).select("path", "rev", "name", "prompt")


@query
def src_generate(spark, sf_dir):
    return generate.map_generate(step_prompts(step(spark, sf_dir)), stand_in()).select("path", "rev", "name", "answer")


@query
def src_generate_again(spark, sf_dir):
    # The second run finds every answer in the store: its model would refuse.
    def refuses() -> generate.TextModel:
        def answer(prompts: list[str]) -> list[str]:
            raise RuntimeError(f"{len(prompts)} prompts asked again")

        return answer

    store = scratch_dir(spark, "store")
    prompts = materialize(step_prompts(step(spark, sf_dir)), "again")
    generate.fill_answers(prompts, stand_in(), store, tasks=8, batch_chars=20_000, rounds=2)
    generate.fill_answers(prompts, refuses, store)
    return generate.with_answers(prompts, store).select("path", "rev", "name", "answer")


@query
def src_validate(spark, sf_dir):
    docs = function_doc_pairs(functions(python_sources(spark, sf_dir)))
    return generate.validate_comment(docs.union(docs.withColumn("doc", F.concat("key", F.lit(": "), "doc"))), "doc").groupBy(
        "path", "rev", "success"
    ).agg(F.count(F.lit(1)).alias("n"))


@query
def src_attempts(spark, sf_dir):
    answers = generate.map_generate(step_prompts(step(spark, sf_dir)), stand_in())
    return generate.attempt_log(answers)


@query
def src_accepted(spark, sf_dir):
    slots = step_slots(step(spark, sf_dir)).withColumn("language", F.lit("python"))
    answers = generate.map_generate(generate.render_prompt(slots, TEMPLATE), stand_in())
    accepted = generate.accepted_insertions(generate.attempt_log(answers), slots)
    return accepted.select("path", "rev", "fn_id", "slot_ln", "replace_to_ln", "slot_col", "comment")


@query
def src_insert(spark, sf_dir):
    pairs = step(spark, sf_dir)
    answers = generate.map_generate(step_prompts(pairs), stand_in())
    valid = generate.accepted_insertions(generate.attempt_log(answers), answers)
    return content_md5(rewrite.apply_insertions(rewrite.new_side(pairs), valid))


@query
def src_update(spark, sf_dir):
    old, new = sources(spark, sf_dir, 0), sources(spark, sf_dir, 1)
    return content_md5(update_docs(old, new, stand_in(), template=TEMPLATE).snapshot)


@query
def src_match_pairs(spark, sf_dir):
    original = function_doc_pairs(functions(python_sources(spark, sf_dir, 0)))
    generated = function_doc_pairs(functions(python_sources(spark, sf_dir, 1)))
    return score.match_pairs(generated, original, ["path"])


@query
def src_comment_pairs(spark, sf_dir):
    old, new = sources(spark, sf_dir, 0), sources(spark, sf_dir, 1)
    documented = update_docs(old, new, stand_in(), template=TEMPLATE).snapshot
    return comment_pairs(python_sources(spark, sf_dir, 1).drop("rev"), new, documented)


@query
def src_snapshot(spark, sf_dir):
    target = scratch_dir(spark, "snapshot")
    write_snapshot(sources(spark, sf_dir, 0, 1), target)
    write_snapshot(sources(spark, sf_dir, 2, 3), target)
    return content_md5(read_snapshot(spark, target))


@query
def load_snapshot_files(spark, sf_dir):
    # A source's path is the folder its file lies in.
    root = scratch_dir(spark, "tree")
    folder = F.coalesce(F.url_encode("path"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    file = F.concat(F.lit("rev="), "rev", F.lit("/path="), folder, F.lit("/part.txt"))
    write_files(sources(spark, sf_dir, *range(4)).select(file.alias("file"), F.concat("content", F.lit("\n")).alias("content")), root)
    folder = F.url_decode(F.regexp_extract("path", "^path=([^/]+)/", 1))
    trees = [load_snapshot(spark, f"{root}/rev={rev}", rev, "*.txt") for rev in range(4)]
    return content_md5(reduce(DataFrame.unionByName, trees).withColumn("path", folder))


# Scores of pairs: a user's turn and the assistant's answer to it.


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    asked = rows.where("role = 'user'").selectExpr("conv_id", "turn", "text AS a")
    replies = rows.where("role = 'assistant'").selectExpr("conv_id", "turn - 1 AS turn", "text AS b")
    return asked.join(replies, ["conv_id", "turn"])


def _score(scored: DataFrame, *keys: str) -> DataFrame:
    return scored.select(*keys, F.round("score", 6).alias("score"))


@query
def pair_jaccard(spark, sf_dir):
    return _score(score.score_jaccard(answered(spark, sf_dir), "a", "b"), "conv_id", "turn")


@query
def pair_levenshtein(spark, sf_dir):
    return _score(score.score_levenshtein(answered(spark, sf_dir), "a", "b"), "conv_id", "turn")


@query
def pair_tfidf(spark, sf_dir):
    return _score(score.score_tfidf(answered(spark, sf_dir), ["conv_id", "turn"], "a", "b"), "conv_id", "turn")


@query
def pair_model(spark, sf_dir):
    def factory() -> score.PairModel:
        return lambda left, right: [min(len(x), len(y)) / max(len(x), len(y), 1) for x, y in zip(left, right)]

    return _score(score.score_model(answered(spark, sf_dir), factory, "a", "b"), "conv_id", "turn")


@query
def pair_embedding(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    first = vectors.groupBy("label").agg(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("first"))
    pairs = salted_join(vectors, first, ["label"], ["vec_id"]).selectExpr(
        "vec_id", "embedding", "first.vec_id AS first_id", "first.embedding AS first_embedding"
    )
    return _score(score.score_embedding(pairs, "embedding", "first_embedding"), "vec_id", "first_id")


# Metrics: a labelled document is an attempt, its quality the success.


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.col("text").alias("comment"))
    return docs.join(table(spark, sf_dir, "labels").selectExpr("doc_id", "quality = 1 AS success"), "doc_id")


@query
def box_stats(spark, sf_dir):
    stats = metrics.box_stats(table(spark, sf_dir, "events"), "value", ["event_type"])
    return rounded(stats, "min", "q1", "median", "q3", "max", "whisker_low", "whisker_high")


@query
def box_stats_null_group(spark, sf_dir):
    grouped = table(spark, sf_dir, "lineitem").selectExpr("nullif(l_linenumber, 2) AS line", "l_extendedprice")
    stats = metrics.box_stats(grouped, "l_extendedprice", ["line"])
    return rounded(stats, "min", "q1", "median", "q3", "max", "whisker_low", "whisker_high")


@query
def box_stats_merged(spark, sf_dir):
    # Sketches of days are stored as runs and merged; the quartiles' true ranks are counted afterwards.
    events, target = table(spark, sf_dir, "events").select("event_type", "value", F.expr("date(ts) AS day")), scratch_dir(spark, "sketches")
    half = metrics.score_sketches(events.where("day(day) % 2 = 0"), "value", ["event_type", "day"])
    rest = metrics.score_sketches(events.where("day(day) % 2 = 1"), "value", ["event_type", "day"])
    for run, rows in (("even", half), ("odd", rest), ("even", half)):  # the third time in place of the first
        replace_run(rows, target, run)
    stats = metrics.box_stats_merged(spark.read.parquet(target), ["event_type"])
    counted = salted_join(events.where("value IS NOT NULL AND NOT isnan(value)"), stats, ["event_type"], ["value"])
    error = 3 * metrics.sketch_error()
    near = [
        F.expr(f"count_if(value < {q}) / count(1) - {error} <= {r} AND count_if(value <= {q}) / count(1) + {error} >= {r} AS {q}_near")
        for q, r in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))
    ]
    return rounded(counted.groupBy("event_type", "n", "min", "max").agg(*near), "min", "max")


@query
def compare_stored_runs(spark, sf_dir):
    scores = table(spark, sf_dir, "documents").selectExpr("lang AS run_id", "source", "n_chars / 1000 AS score")
    sketches = materialize(metrics.score_sketches(scores, "score", ["run_id", "source"]), "sketches")
    runs = metrics.compare_stored_runs(sketches, labelled(spark, sf_dir).withColumnRenamed("lang", "run_id"))
    return rounded(runs, "min", "max", "ratio", "ratio_change").select("run_id", "n", "min", "max", "total", "successes", "ratio", "ratio_change")


@query
def success_ratio(spark, sf_dir):
    return rounded(metrics.success_ratio(labelled(spark, sf_dir), ["source"]), "ratio")


@query
def failure_sample(spark, sf_dir):
    return metrics.failure_sample(labelled(spark, sf_dir), key="doc_id").select("pick", "doc_id", "source")


@query
def success_report(spark, sf_dir):
    return metrics.success_report(labelled(spark, sf_dir), key="doc_id")


@query
def compare_runs(spark, sf_dir):
    scores = table(spark, sf_dir, "documents").selectExpr("lang AS run_id", "n_chars / 1000 AS score")
    attempts = labelled(spark, sf_dir).withColumnRenamed("lang", "run_id")
    names = ("min", "q1", "median", "q3", "max", "whisker_low", "whisker_high", "ratio", "median_change", "ratio_change")
    return rounded(metrics.compare_runs(scores, attempts), *names)


# Result files: written from the tables in the layout of a run, then loaded.


@query
def load_score_files(spark, sf_dir):
    root = scratch_dir(spark, "scores")
    rows = score.score_jaccard(answered(spark, sf_dir), "a", "b").selectExpr(
        "round(score, 6) AS `Semantic-Score`", "concat('def f_', conv_id) AS Code", "a AS `Original-Comment`",
        "b AS `Agent-Comment`", "concat(conv_id, '.py') AS Filename", "cast(turn AS string) AS `Agent-Commit`",
    )
    rows.write.csv(f"{root}/run_1/semantic_score.csv", header=True, escape='"', quoteAll=True)
    return load_scores(spark, root)


@query
def load_attempt_files(spark, sf_dir):
    root = scratch_dir(spark, "attempts")
    literal = F.replace(F.replace(F.replace("comment", F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("\n"), F.lit("\\n"))
    lines = labelled(spark, sf_dir).select(
        F.concat(F.initcap(F.col("success").cast("string")), F.lit(", '"), literal, F.lit("'")).alias("value")
    )
    lines.write.text(f"{root}/run_1/success_rate.csv")
    return load_attempts(spark, root).selectExpr("run_id", "success", "md5(comment) AS comment_md5")


@query
def append_runs(spark, sf_dir):
    target = scratch_dir(spark, "runs")
    rows = labelled(spark, sf_dir).select("doc_id", "success")
    append_run(rows.where("success"), target, "good")
    append_run(rows.where("NOT success"), target, "bad")
    return spark.read.schema("doc_id bigint, success boolean, run_id string").parquet(target)


# Replay and streams.


def _replay(spark: SparkSession, sf_dir: str):
    files = sources(spark, sf_dir)
    commits = files.select("rev").distinct()
    return replay_history(files, commits, 0, 3, stand_in(), TEMPLATE)


@query
def replay_events(spark, sf_dir):
    return _replay(spark, sf_dir).events


@query
def replay_docs(spark, sf_dir):
    return _replay(spark, sf_dir).docs


@query
def replay_tree(spark, sf_dir):
    return content_md5(_replay(spark, sf_dir).tree)


@query
def replay_scores(spark, sf_dir):
    files, target = sources(spark, sf_dir), scratch_dir(spark, "replay-scores")
    replay = _replay(spark, sf_dir)
    for _ in range(2):  # the second time in place of the first
        rows = score_replay(replay, files, lambda pairs: score.score_jaccard(pairs, "original_comment", "agent_comment"), target, "replay")
    return rounded(rows, "score")


def deleted_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built sources of which some files are deleted at revision 2 and come back, and some are deleted at revision 3."""
    gone = "(path LIKE '%3.py' AND rev = 2) OR (path LIKE '%4.py' AND rev = 3)"
    return sources(spark, sf_dir).withColumn("content", F.expr(f"CASE WHEN NOT ({gone}) THEN content END"))


@query
def replay_deleted(spark, sf_dir):
    files = materialize(deleted_sources(spark, sf_dir), "deleted")
    commits = files.select("rev").distinct()
    drop, keep = (replay_history(files, commits, 0, 3, stand_in(), TEMPLATE, keep_deleted=k).docs.withColumn("keep", F.lit(k)) for k in (False, True))
    return drop.unionByName(keep)


@query
def src_path_lives(spark, sf_dir):
    files = deleted_sources(spark, sf_dir)
    drop, keep = (path_lives(files, keep_deleted=k).withColumn("keep", F.lit(k)) for k in (False, True))
    return drop.unionByName(keep)


def _feed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # As a glob the table may be one file or, as Spark writes it, a folder of files; a plain path must be a folder.
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{{{name}}}.parquet")


@query
def stream_ratio(spark, sf_dir):
    attempts = _feed(spark, sf_dir, "events").selectExpr("cast(ts AS timestamp) AS ts", "event_type <> 'error' AS success")
    target, checkpoint = scratch_dir(spark, "ratio"), scratch_dir(spark, "ratio-query")
    ratios = stream_success_ratio(attempts)
    (
        ratios.writeStream.outputMode("append")
        .format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    written = rounded(spark.read.schema(ratios.schema).parquet(target), "ratio")
    return written.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query
def stream_changed(spark, sf_dir):
    feed = _feed(spark, sf_dir, "conversations").selectExpr(
        "cast(conv_id AS string) AS path", "turn AS rev", "text AS content"
    )
    target = scratch_dir(spark, "lines")
    stream_changed_lines(feed, target, scratch_dir(spark, "lines-query"), "multiset").awaitTermination()
    rows = spark.read.schema("path string, rev bigint, ln int").option("recursiveFileLookup", "true").parquet(target)
    return _by_conversation(rows)


@query
def stream_functions(spark, sf_dir):
    staged, target = scratch_dir(spark, "feed"), scratch_dir(spark, "functions")
    files = python_sources(spark, sf_dir)
    files.write.parquet(staged)
    feed = spark.readStream.schema(files.schema).parquet(staged)
    stream_changed_functions(feed, target, scratch_dir(spark, "functions-query")).awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").schema("path string, rev bigint, name string").parquet(target)
