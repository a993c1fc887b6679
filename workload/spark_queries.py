"""The registered queries: name -> function of (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from changeledger.functions.checksum import script_checksum
from changeledger.functions.paths import CALLBACK_SCRIPTS, PathFilter, directory_version
from changeledger.functions.redact import redact
from changeledger.functions.selection import VersionSelection
from changeledger.functions.splitter import MYSQL, ORACLE, POSTGRESQL, Dialect, split_statements, with_batches
from changeledger.functions.versions import version_key
from changeledger.operators import history, pending as pending_ops, problems as problem_ops
from changeledger.operators import state as state_ops
from changeledger.operators.catalog import build_catalog, classify, duplicate_versions
from changeledger.operators.distribute import fixed
from changeledger.operators.report import info_report
from changeledger.operators.snapshot import ledger_snapshot
from changeledger.operators.statements import (
    dry_run, failing_statements, missing_texts, placeholder_problems, resolve_text)
from changeledger.operators.suggest import nearest_key
from changeledger.plans.commands import Reconciler
from changeledger.schema import LEDGER_COLUMNS, LEDGER_SCHEMA
from changeledger.sources.commits import advance_snapshot, append_run, last_commit, read_commits, repair_in_place
from workload import frames as fx
from workload.dialects import DOLLAR_FORMS, MYSQL_FORMS, ORACLE_FORMS

KNOWN_WORDS = ["the", "and", "worthless", "international", "whst", "einachie", "quality"]

EXACT = VersionSelection(target="1.4")
RANGE = VersionSelection(start="0.7", end="2.2")
RANGE_TO_FAMILY = VersionSelection(start="0.7", end="2")
FAMILY = VersionSelection(mode="family", target="1")
FAMILY_RANGE = VersionSelection(mode="family-range", start="0.7", end="2")
REGEX = VersionSelection(mode="regex", regex=r"0*[12][._]\d.*")
DIRECTORY = VersionSelection(mode="family", target="1", by_directory=True)
NO_HIT = VersionSelection(target="3.7")


def _view(spark, sf) -> DataFrame:
    return state_ops.state_view(fx.catalog(spark, sf), fx.ledger(spark, sf))


def state_view(spark, sf):
    return _state_columns(_view(spark, sf))


def _state_columns(view: DataFrame) -> DataFrame:
    return view.select(
        "target", state_ops.effective("script").alias("script"), "state",
        F.col("resolved.version").alias("version"), F.col("applied.version").alias("applied_version"),
        *(F.col(field).cast("string").alias(name) for field, name in (
            ("applied.installed_rank", "installed_rank"), ("resolved.checksum", "checksum"),
            ("applied.checksum", "applied_checksum"))))


def state_counts(spark, sf):
    return state_ops.state_counts(_view(spark, sf))


def state_summary(spark, sf):
    return state_ops.state_summary(_view(spark, sf))


def pending_states(spark, sf):
    return state_ops.pending_view(_view(spark, sf)).select(
        "target", state_ops.effective("script").alias("script"), "state")


def applied_states(spark, sf):
    return state_ops.applied_view(_view(spark, sf)).select(
        "target", state_ops.effective("script").alias("script"), "state")


def problems(spark, sf):
    return problem_ops.validation_problems(_view(spark, sf))


def problem_details(spark, sf):
    return problem_ops.with_explanations(
        problem_ops.problems_per_target(problems(spark, sf)), from_validation=True).select(
        "target", "code", "problems", "summary", "severity")


def current_version(spark, sf):
    return state_ops.current_version(_view(spark, sf))


def latest_per_item(spark, sf):
    return state_ops.latest_per_item(fx.ledger(spark, sf)).select(
        "target", "applied.script", "applied.version", "applied.installed_rank", "applied.type",
        "applied.success")


def failed_gate(spark, sf):
    return pending_ops.failed_gate(fx.ledger(spark, sf))


def _pending(selection=pending_ops.EVERYTHING, out_of_order=True):
    def query(spark, sf):
        return pending_ops.pending(fx.catalog(spark, sf), fx.ledger(spark, sf), selection,
                                   out_of_order).select("target", "script", "version")
    return query


def verdicts(spark, sf):
    return pending_ops.verdicts(fx.catalog(spark, sf), fx.ledger(spark, sf)).select(
        "target", "script", "verdict")


def pending_out_of_order(spark, sf):
    return pending_ops.pending_problems(fx.catalog(spark, sf), fx.ledger(spark, sf))


def pending_no_hit(spark, sf):
    return pending_ops.selection_without_hit(fx.catalog(spark, sf), NO_HIT)


def range_end_warning(spark, sf):
    return pending_ops.range_end_warning(fx.catalog(spark, sf), RANGE_TO_FAMILY).select(
        "target", F.array_join("versions", " ").alias("versions"), "left_out")


def _plan(spark, sf) -> DataFrame:
    return pending_ops.pending(fx.catalog(spark, sf), fx.ledger(spark, sf), out_of_order=True)


def validated_plan(spark, sf):
    catalog, ledger = fx.split_targets(fx.catalog(spark, sf)), fx.split_targets(fx.ledger(spark, sf))
    return Reconciler(catalog, ledger, out_of_order=True).plan().select("target", "script")


def plan_progress(spark, sf):
    return pending_ops.with_progress(_plan(spark, sf)).select("target", "script", "step", "steps")


def version_reached(spark, sf):
    return history.version_reached(fx.ledger(spark, sf), _plan(spark, sf))


def undo_plan(spark, sf):
    plan, _ = history.undo_plan(fx.targets(spark, sf), fx.catalog(spark, sf), fx.ledger(spark, sf))
    return plan.select("target", "script", "version", "checksum")


def undo_problems(spark, sf):
    _, found = history.undo_plan(fx.targets(spark, sf), fx.catalog(spark, sf), fx.ledger(spark, sf))
    return found


def undo_records(spark, sf):
    plan, _ = history.undo_plan(fx.targets(spark, sf), fx.catalog(spark, sf), fx.ledger(spark, sf))
    return _records(spark, sf, plan)


def repair_ledger(spark, sf):
    return history.repair(fx.catalog(spark, sf), fx.ledger(spark, sf))[0]


def repair_report(spark, sf):
    return history.repair(fx.catalog(spark, sf), fx.ledger(spark, sf))[1]


def repair_counts(spark, sf):
    return history.repair_counts(repair_report(spark, sf))


def _moment():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def baseline_rows(spark, sf):
    records, _ = history.baseline(fx.fleet(spark, sf), fx.ledger(spark, sf), "1.0", "runner", _moment())
    return records.drop("checksum")


def baseline_problems(spark, sf):
    return history.baseline(fx.fleet(spark, sf), fx.ledger(spark, sf), "1.0")[1]


def _records(spark, sf, plan):
    return history.record_outcomes(plan, fx.outcomes(spark, sf), fx.targets(spark, sf),
                                   fx.ledger(spark, sf), "runner", _moment())


def record_outcomes(spark, sf):
    return _records(spark, sf, _plan(spark, sf))


def info_rows(spark, sf):
    return info_report(_view(spark, sf))


def version_order(spark, sf):
    version = F.concat(F.col("l_orderkey").cast("string"), F.lit("."),
                       F.col("l_linenumber").cast("string"), F.lit("-B0"),
                       F.col("l_partkey").cast("string"))
    rows = fx.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("flag"), version.alias("version"))
    keyed = rows.distinct().withColumn("vsort", version_key(F.col("version")))
    # One row per version first: a hot flag meets no large distinct set.
    once = keyed.groupBy("flag", "vsort").agg(F.min("version").alias("version"))
    return once.groupBy("flag").agg(
        F.min_by("version", "vsort").alias("lowest"), F.max_by("version", "vsort").alias("highest"),
        F.count("*").alias("versions"))


def path_filter(spark, sf):
    chosen = PathFilter(directory_glob="**/en", file_regex=r"\d+(\.html)?", path_glob="*.example.*/**")
    return fx.page_paths(spark, sf).filter(chosen.matches(F.col("path"))).select("page_id", "path")


def dir_version(spark, sf):
    script = F.concat(F.col("path"), F.lit("/f.sql"))
    return fx.page_paths(spark, sf).select(
        "page_id", directory_version(script).alias("dir_version"))


def classify_names(spark, sf):
    return classify(fx.page_scripts(spark, sf)).select(
        "target", "script", "kind", "version", "description")


def catalog_rows(spark, sf):
    catalog, _ = build_catalog(fx.page_scripts(spark, sf), directory_versions=True)
    return catalog.select("target", "script", "kind", "version", "dir_version", "description")


def catalog_problems(spark, sf):
    _, found = build_catalog(fx.page_scripts(spark, sf), directory_versions=True)
    return found.select("target", "code", "script")


def duplicates(spark, sf):
    rows = classify(fx.page_scripts(spark, sf)).withColumn("checksum", F.lit(0))
    return duplicate_versions(rows)


def placeholders(spark, sf):
    rows = fx.scripts(spark, sf).select("target", "script", fx.with_placeholders(F.col("text")).alias("text"))
    return resolve_text(rows, fx.targets(spark, sf)).select("target", "script", "text")


def undefined(spark, sf):
    rows = fx.scripts(spark, sf).select("target", "script", fx.with_placeholders(F.col("text")).alias("text"))
    return placeholder_problems(rows, fx.targets(spark, sf))


def split(spark, sf):
    return split_statements(fx.statement_scripts(spark, sf)).select("script", "stmt_no", "line", "sql")


def statement_batches(spark, sf):
    return (with_batches(split_statements(fx.statement_scripts(spark, sf)), 3)
            .groupBy("script", "batch_no").agg(F.count("*").alias("statements"), F.min("line").alias("line")))


def failing(spark, sf):
    return failing_statements(split_statements(fx.statement_scripts(spark, sf)),
                              fx.outcomes(spark, sf), batch_size=3)


def failing_by_target(spark, sf):
    named = fx.shared_names(fx.scripts(spark, sf))
    texts = named.select("target", "script", fx.as_statements(F.col("text")).alias("text"))
    done = named.select("target", "script", (F.col("checksum") % 5 != 0).alias("success"),
                        (F.col("doc_id") % 4).cast("int").alias("batch_no"),
                        (F.col("checksum") % 3).alias("applied_in_batch"))
    return failing_statements(split_statements(texts), done, batch_size=3)


def _default(spark, sf) -> Reconciler:
    return Reconciler(fx.split_targets(fx.catalog(spark, sf)), fx.split_targets(fx.ledger(spark, sf)))


def plan_default(spark, sf):
    return _default(spark, sf).plan().select("target", "script")


def dry_run_default(spark, sf):
    texts = fx.split_targets(fx.scripts(spark, sf)).select(
        "target", "script", fx.as_statements(F.col("text")).alias("text"))
    return _default(spark, sf).dry_run(texts)[0].select("target", "script", "stmt_no", "line", "sql")


def gated_plan(spark, sf):
    catalog, found = build_catalog(fx.page_fleet(spark, sf), directory_versions=True)
    empty = spark.createDataFrame([], LEDGER_SCHEMA)
    return Reconciler(catalog, empty, catalog_problems=found).plan().select("target", "script")


def duplicate_locations(spark, sf):
    return build_catalog(fx.page_locations(spark, sf))[1].filter("code = '2002'")


def _partial_outcomes(spark, sf):
    number = F.regexp_extract("script", r"__d(\d+)\.sql", 1).cast("long")
    return fx.outcomes(spark, sf).filter(number % 9 != 0)


def record_partial(spark, sf):
    some = fx.targets(spark, sf).filter("target <> 'src5'")
    return history.record_outcomes(_plan(spark, sf), _partial_outcomes(spark, sf), some,
                                   fx.ledger(spark, sf), "runner", _moment())


def record_problems(spark, sf):
    some = fx.targets(spark, sf).filter("target <> 'src5'")
    return history.record_problems(_plan(spark, sf), _partial_outcomes(spark, sf), some)


def _doubled_targets(spark, sf) -> DataFrame:
    return fx.targets(spark, sf).unionByName(fx.targets(spark, sf))


def record_repeated(spark, sf):
    return history.record_outcomes(_plan(spark, sf), fx.repeated_outcomes(spark, sf), _doubled_targets(spark, sf),
                                   fx.ledger(spark, sf), "runner", _moment())


def repeat_problems(spark, sf):
    return history.record_problems(_plan(spark, sf), fx.repeated_outcomes(spark, sf), _doubled_targets(spark, sf))


def repair_untouched(spark, sf):
    """What is not repaired stays as it was: blank versions, and records without a target."""
    return history.repair(fx.catalog(spark, sf), fx.odd_ledger(spark, sf))[0].withColumn(
        "checksum", F.col("checksum").cast("string"))


def untouched_report(spark, sf):
    return history.repair(fx.catalog(spark, sf), fx.odd_ledger(spark, sf))[1]


def repair_delta(spark, sf):
    """A ledger of commits after repair of the parts that needed it."""
    path = fx.ledger_folder(spark, sf)
    repair_in_place(fx.catalog(spark, sf), path)
    return read_commits(spark, path).select(*LEDGER_COLUMNS)


def _appended(spark, sf):
    """A ledger folder to which one plan was appended by a run, by the same run again and by another run."""
    path = fx.ledger_folder(spark, sf)
    before = last_commit(spark, path)
    records = fixed(_records(spark, sf, _plan(spark, sf)))
    append_run(records, path, "night-1", before, parts=16)
    append_run(records, path, "night-1", before, parts=16)
    conflicts = append_run(records, path, "night-2", before, parts=16)
    return read_commits(spark, path, after=before), conflicts


def append_repeated(spark, sf):
    return _appended(spark, sf)[0].select(*LEDGER_COLUMNS)


def append_conflicts(spark, sf):
    return _appended(spark, sf)[1]


def _grown_snapshot(spark, sf):
    """A snapshot of the first commits, and the one that grows from it by the last commit."""
    path = fx.ledger_folder(spark, sf)
    state, last = f"{path}-state", last_commit(spark, path)
    snapshot = ledger_snapshot(read_commits(spark, path, upto=last - 1))
    snapshot.write.parquet(f"{state}/repairs=0/upto={last - 1}")
    return advance_snapshot(spark, path, state)


def state_incremental(spark, sf):
    return _state_columns(state_ops.state_view(fx.catalog(spark, sf), _grown_snapshot(spark, sf)))


def pending_incremental(spark, sf):
    return pending_ops.pending(fx.catalog(spark, sf), _grown_snapshot(spark, sf), out_of_order=True).select(
        "target", "script", "version")


def _dialect(forms, dialect):
    def query(spark, sf):
        texts = fx.dialect_scripts(spark, sf, [form[0] for form in forms])
        return split_statements(texts, dialect).select("target", "script", "stmt_no", "line", "sql")
    return query


def callback_names(spark, sf):
    """Names of hooks, of nearly hooks and of hooks below the root."""
    names = [*CALLBACK_SCRIPTS, "beforemigrate.sql", "beforeMigrate.SQL", "afterUndo2.sql", "V1__beforeMigrate.sql"]
    doc = F.col("doc_id")
    name = F.element_at(F.array(*map(F.lit, names)), (doc % len(names) + 1).cast("int"))
    script = F.when(F.floor(doc / 20) % 3 == 2, F.concat("lang", F.lit("/"), name)).otherwise(name)
    return classify(fx.table(spark, sf, "documents").select("doc_id", script.alias("script"))).select("doc_id", "script", "kind")


def plan_by_directory(spark, sf):
    """Steps of a plan whose folders go against the order of versions."""
    number = F.floor(F.substring("description", 2, 20).cast("long") / 20) % 7
    catalog = fx.catalog(spark, sf).withColumn("dir_version", F.when(F.col("version").isNotNull(), number.cast("string")))
    plan = pending_ops.pending(catalog, fx.ledger(spark, sf), out_of_order=True, by_directory=True)
    return pending_ops.with_progress(plan).select("target", "script", "step", "steps")


def dry_run_undo(spark, sf):
    run = Reconciler(fx.catalog(spark, sf), fx.ledger(spark, sf), fx.targets(spark, sf))
    return run.dry_run_undo(fx.statement_scripts(spark, sf))[0].select("target", "script", "kind", "stmt_no", "line", "sql")


def dry_run_plain(spark, sf):
    """Without substitution: placeholders are sent as they are, and undefined ones hold nothing back."""
    texts = fx.statement_scripts(spark, sf).withColumn("text", fx.with_placeholders(F.col("text")))
    return dry_run(_plan(spark, sf), texts, fx.targets(spark, sf), Dialect(), substitution=False).select(
        "target", "script", "kind", "stmt_no", "line", "sql")


def unknown_checksums(spark, sf):
    """Problems where one side or both sides have no checksum."""
    number, rank = F.substring("description", 2, 20).cast("long"), F.col("installed_rank")
    catalog = fx.catalog(spark, sf).withColumn("checksum", F.when(number % 4 != 0, F.col("checksum")))
    ledger = fx.ledger(spark, sf).withColumn("checksum", F.when(rank % 3 != 0, F.col("checksum")))
    return problem_ops.validation_problems(state_ops.state_view(catalog, ledger))


def no_hit_asked(spark, sf):
    return pending_ops.selection_without_hit(fx.catalog(spark, sf), NO_HIT, fx.fleet(spark, sf))


def missing_texts_of_plan(spark, sf):
    texts = fx.statement_scripts(spark, sf).filter(F.length("text") % 7 != 0)
    return missing_texts(_plan(spark, sf), texts)


def dry_run_plan(spark, sf):
    return dry_run(_plan(spark, sf), fx.statement_scripts(spark, sf), fx.targets(spark, sf)).select(
        "target", "script", "kind", "stmt_no", "line", "sql")


def masked(spark, sf):
    line = F.concat(F.lit("jdbc:x://user:"), F.col("source"), F.lit("@host Password= "), F.col("lang"),
                    F.lit("\n"), F.col("text"))
    return fx.table(spark, sf, "documents").select(
        "doc_id", redact(line, secret="the").alias("text"))


def nearest(spark, sf):
    words = fx.table(spark, sf, "documents").select(
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("key"))
    return nearest_key(words, KNOWN_WORDS)


def checksum(spark, sf):
    texts = fx.table(spark, sf, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("script"), F.encode("text", "UTF-8").alias("content"))
    pages = fx.table(spark, sf, "pages").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("script"), F.encode("html", "UTF-8").alias("content"))
    return texts.unionByName(pages).select("script", script_checksum(F.col("content")).alias("checksum"))


QUERIES = {
    "state_view": state_view,
    "state_counts": state_counts,
    "state_summary": state_summary,
    "pending_states": pending_states,
    "applied_states": applied_states,
    "problems": problems,
    "problem_details": problem_details,
    "current_version": current_version,
    "latest_per_item": latest_per_item,
    "failed_gate": failed_gate,
    "verdicts": verdicts,
    "pending_all": _pending(),
    "pending_strict": _pending(out_of_order=False),
    "pending_exact": _pending(EXACT),
    "pending_range": _pending(RANGE),
    "pending_family": _pending(FAMILY),
    "pending_family_range": _pending(FAMILY_RANGE),
    "pending_regex": _pending(REGEX),
    "pending_directory": _pending(DIRECTORY),
    "pending_out_of_order": pending_out_of_order,
    "pending_no_hit": pending_no_hit,
    "range_end_warning": range_end_warning,
    "validated_plan": validated_plan,
    "plan_progress": plan_progress,
    "version_reached": version_reached,
    "undo_plan": undo_plan,
    "undo_problems": undo_problems,
    "undo_records": undo_records,
    "repair_ledger": repair_ledger,
    "repair_report": repair_report,
    "repair_counts": repair_counts,
    "baseline_rows": baseline_rows,
    "baseline_problems": baseline_problems,
    "record_outcomes": record_outcomes,
    "info_report": info_rows,
    "version_order": version_order,
    "path_filter": path_filter,
    "dir_version": dir_version,
    "classify_names": classify_names,
    "catalog_rows": catalog_rows,
    "catalog_problems": catalog_problems,
    "duplicate_versions": duplicates,
    "placeholders": placeholders,
    "undefined_placeholders": undefined,
    "split_statements": split,
    "statement_batches": statement_batches,
    "failing_statement": failing,
    "failing_by_target": failing_by_target,
    "plan_default": plan_default,
    "dry_run_default": dry_run_default,
    "gated_plan": gated_plan,
    "duplicate_locations": duplicate_locations,
    "record_partial": record_partial,
    "record_problems": record_problems,
    "record_repeated": record_repeated,
    "repeat_problems": repeat_problems,
    "repair_untouched": repair_untouched,
    "untouched_report": untouched_report,
    "repair_delta": repair_delta,
    "append_repeated": append_repeated,
    "append_conflicts": append_conflicts,
    "state_incremental": state_incremental,
    "pending_incremental": pending_incremental,
    "split_mysql": _dialect(MYSQL_FORMS, MYSQL),
    "split_oracle": _dialect(ORACLE_FORMS, ORACLE),
    "split_dollar": _dialect(DOLLAR_FORMS, POSTGRESQL),
    "callback_names": callback_names,
    "plan_by_directory": plan_by_directory,
    "dry_run_undo": dry_run_undo,
    "dry_run_plain": dry_run_plain,
    "unknown_checksums": unknown_checksums,
    "no_hit_asked": no_hit_asked,
    "missing_texts": missing_texts_of_plan,
    "dry_run": dry_run_plan,
    "redact": masked,
    "nearest_key": nearest,
    "checksum": checksum,
}
