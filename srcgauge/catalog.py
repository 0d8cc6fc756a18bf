"""Every operator as a named query over the given tables.

Nested results are flattened to plain columns, so that they can be compared
with another engine's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import findings, metrics
from .functions import sqltext as E
from .operators import display, duplicates, files, functions, heat, history
from .plans import analysis
from .sources import code_files as submitted
from .sources import corpora, pages
from .sources.tables import table
from .streaming import jobs
from .streaming.shared import fresh_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

docs = corpora.doc_files
code = corpora.code_files


def query(name: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return add


def joined(names: str = "params") -> Column:
    return F.array_join(names, "|").alias(names)


def cents(value: Column) -> Column:
    return F.floor(value * 100 + 0.5).cast("bigint")


def analysed_at() -> Column:
    """A fixed time per file, so that results do not depend on the clock."""
    return F.timestamp_seconds(F.lit(1_704_067_200) + F.col("file_id") * 60)


# -- sources and gates --------------------------------------------------------
@query("src_code_files")
def _(spark, sf):
    raw = table(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("file_id"),
        F.when(F.col("role") == "user", F.concat(F.lit("c"), "conv_id", F.lit(".py"))).alias(
            "filename"
        ),
        F.when(F.col("turn") % 5 != 4, F.concat("text", F.lit("\r\n"))).alias("code"),
    )
    accepted = submitted.submissions(raw).withColumn("error", F.lit(""))
    rejected = submitted.rejected_submissions(raw).select(
        "file_id", F.coalesce("filename", F.lit("")).alias("filename"), F.lit("").alias("code"), "error"
    )
    return accepted.unionByName(rejected)


@query("page_is_file")
def _(spark, sf):
    is_file = pages.page_is_file(E.col("url"), E.col("html")).alias("is_file")
    return corpora.saved_pages(spark, sf).select("kind", "page_id", is_file)


@query("page_repo_parts")
def _(spark, sf):
    return (
        corpora.saved_pages(spark, sf)
        .select("kind", "page_id", pages.page_repo_parts(E.col("url")).alias("r").column)
        .select(
            "kind",
            "page_id",
            F.coalesce("r.owner", F.lit("")).alias("owner"),
            F.coalesce("r.repo", F.lit("")).alias("repo"),
        )
    )


@query("page_file_name")
def _(spark, sf):
    name = pages.page_file_name(E.col("url"), E.col("html")).alias("filename")
    return corpora.saved_pages(spark, sf).select("kind", "page_id", name)


@query("page_code_text")
def _(spark, sf):
    text = F.coalesce(pages.page_code_text(E.col("html")), F.lit("")).alias("code")
    return corpora.saved_pages(spark, sf).select("kind", "page_id", text)


@query("pages_to_files")
def _(spark, sf):
    return files.file_summary(pages.pages_to_files(corpora.saved_pages(spark, sf))).select(
        "file_id", "filename", "loc", "cyclomaticComplexity"
    )


@query("analyzable_gate")
def _(spark, sf):
    return files.analyzable(docs(spark, sf)).select("file_id", "filename", "language")


# -- scalars on files ---------------------------------------------------------
@query("language_detect")
def _(spark, sf):
    return files.with_language(docs(spark, sf)).select("file_id", "filename", "language")


@query("unsupported_split")
def _(spark, sf):
    return files.unsupported(docs(spark, sf))


@query("line_split")
def _(spark, sf):
    return files.lines(docs(spark, sf)).select("file_id", "line", "text")


@query("line_class")
def _(spark, sf):
    both = files.lines(docs(spark, sf)).unionByName(files.lines(code(spark, sf)))
    return both.groupBy("file_id", "line_class").agg(
        F.count("*").alias("n"), F.sum("line").alias("line_sum")
    )


@query("line_counts")
def _(spark, sf):
    return files.file_summary(code(spark, sf)).select(
        "file_id", "loc", "sloc", "blankLines", "commentLines"
    )


@query("strip_noise")
def _(spark, sf):
    return files.clean_files(docs(spark, sf)).select("file_id", "clean")


@query("token_extract")
def _(spark, sf):
    return files.tokens(code(spark, sf)).select("file_id", "pos", "token")


@query("token_class")
def _(spark, sf):
    return files.classified_tokens(docs(spark, sf))


@query("decision_counts")
def _(spark, sf):
    def long(language: str) -> DataFrame:
        wide = files_with_counts(language)
        kinds = [c for c in wide.columns if c != "file_id"]
        return wide.select(
            "file_id",
            F.explode(
                F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in kinds))
            ).alias("x"),
        ).select("file_id", "x.*")

    def files_with_counts(language: str) -> DataFrame:
        return functions.decision_counts(code(spark, sf), language)

    return long("python").unionByName(long("javascript"))


@query("cyclomatic")
def _(spark, sf):
    cc = metrics.cyclomatic(files.CODE, files.LANG).alias("cc").column
    return files.supported(docs(spark, sf)).select("file_id", cc)


@query("halstead")
def _(spark, sf):
    h = metrics.halstead(files.CODE, files.LANG).alias("h").column
    return files.supported(docs(spark, sf)).select("file_id", h).select("file_id", "h.*")


@query("maintainability")
def _(spark, sf):
    return files.file_summary(docs(spark, sf)).select("file_id", "maintainabilityIndex")


def _levels(df: DataFrame, column: str) -> DataFrame:
    return df.select("file_id", f"{column}.*")


@query("cc_level")
def _(spark, sf):
    return _levels(files.file_summary(code(spark, sf)), "complexityLevel")


@query("mi_level")
def _(spark, sf):
    return _levels(files.file_summary(docs(spark, sf)), "maintainabilityLevel")


@query("file_summary")
def file_summary(spark, sf):
    return flat_summary(files.file_summary(docs(spark, sf)))


@query("file_summary_service")
def _(spark, sf):
    return flat_summary(files.file_summary(code(spark, sf), "service"))


def flat_summary(df: DataFrame) -> DataFrame:
    return df.select(
        "file_id",
        "filename",
        "language",
        "loc",
        "sloc",
        "blankLines",
        "commentLines",
        "cyclomaticComplexity",
        F.col("complexityLevel.label").alias("complexityLabel"),
        "maintainabilityIndex",
        F.col("maintainabilityLevel.label").alias("maintainabilityLabel"),
        "halstead.*",
    )


@query("case_count")
def _(spark, sf):
    return functions.case_counts(code(spark, sf))


@query("token_freq")
def _(spark, sf):
    return files.token_freq(code(spark, sf))


@query("token_totals")
def _(spark, sf):
    return files.token_totals(docs(spark, sf))


# -- functions ----------------------------------------------------------------
@query("functions_js")
def _(spark, sf):
    return functions.functions_js_raw(code(spark, sf)).select(
        "file_id", "pattern", "seq", "name", joined(), "startLine"
    )


@query("functions_dedupe")
def _(spark, sf):
    return functions.functions_dedupe(code(spark, sf))


@query("functions_py")
def _(spark, sf):
    return functions.functions_py_raw(code(spark, sf)).select(
        "file_id", "seq", "name", joined(), "startLine", "indent"
    )


@query("functions_py_line_anchor")
def _(spark, sf):
    return functions.functions_py_raw(code(spark, sf), anchor="line").select(
        "file_id", "seq", "name", joined(), "startLine", "indent"
    )


def _spans(spark, sf, python: bool) -> DataFrame:
    rows = functions.function_spans(code(spark, sf))
    wanted = F.col("language") == "python" if python else F.col("language") != "python"
    return rows.filter(wanted).select("file_id", "ord", "name", "startLine", "endLine", "loc")


@query("function_end_brace")
def _(spark, sf):
    return _spans(spark, sf, python=False)


@query("function_end_indent")
def _(spark, sf):
    return _spans(spark, sf, python=True)


@query("function_body")
def _(spark, sf):
    return functions.function_bodies(code(spark, sf))


@query("params_js")
def _(spark, sf):
    rows = functions.functions_all(code(spark, sf)).filter(F.col("language") != "python")
    return rows.select("file_id", "ord", joined(), "paramCount")


@query("params_py")
def _(spark, sf):
    rows = functions.functions_all(code(spark, sf)).filter(F.col("language") == "python")
    return rows.select("file_id", "ord", joined(), "paramCount")


def _measured(spark, sf) -> DataFrame:
    return functions.nesting_and_returns(code(spark, sf))


@query("nesting_brace")
def _(spark, sf):
    rows = _measured(spark, sf).filter(F.col("language") != "python")
    return rows.select("file_id", "ord", "maxNestingDepth")


@query("nesting_indent")
def _(spark, sf):
    rows = _measured(spark, sf).filter(F.col("language") == "python")
    return rows.select("file_id", "ord", "maxNestingDepth")


@query("return_count")
def _(spark, sf):
    return _measured(spark, sf).select("file_id", "ord", "returns")


def flat_functions(df: DataFrame) -> DataFrame:
    return df.select(
        "file_id",
        "ord",
        "name",
        "startLine",
        "endLine",
        "loc",
        joined(),
        "paramCount",
        "cyclomaticComplexity",
        F.col("complexityLevel.label").alias("complexityLabel"),
        "maintainabilityIndex",
        F.col("maintainabilityLevel.label").alias("maintainabilityLabel"),
        "maxNestingDepth",
        F.floor(F.col("heatIntensity") * 1e6 + 0.5).alias("heat_millionths"),
        "halstead.*",
    )


@query("functions_all")
def _(spark, sf):
    return flat_functions(functions.functions_all(code(spark, sf)))


@query("functions_all_service")
def _(spark, sf):
    return flat_functions(functions.functions_all(code(spark, sf), "service"))


@query("functions_ranked")
def _(spark, sf):
    return functions.functions_ranked(code(spark, sf))


@query("file_max_cc")
def _(spark, sf):
    return functions.file_max_cc(code(spark, sf))


# -- duplicates ---------------------------------------------------------------
@query("dup_logic_pairs")
def _(spark, sf):
    return duplicates.duplicate_pairs(code(spark, sf)).select(
        "file_id", "i", "j", "first", "second", "percent"
    )


@query("dup_logic_pairs_spread")
def _(spark, sf):
    """The pairs of the nested analysis, spread into rows."""
    return duplicates.listed_pairs(code(spark, sf)).select(
        "file_id", "i", "j", "first", "second", "percent"
    )


@query("token_jaccard")
def _(spark, sf):
    return duplicates.body_similarity(code(spark, sf)).select(
        "file_id", "i", F.floor(F.col("similarity") * 1e6 + 0.5).alias("similarity_millionths")
    )


@query("set_intersect_union")
def _(spark, sf):
    return duplicates.body_similarity(code(spark, sf)).select("file_id", "i", "shared", "combined")


# -- heat ---------------------------------------------------------------------
def _millionths(name: str) -> Column:
    return F.floor(F.col(name) * 1e6 + 0.5).alias(f"{name}_millionths")


@query("heat_intensity")
def _(spark, sf):
    return heat.heat_intensity(code(spark, sf)).select(
        "file_id", "ord", "name", "cyclomaticComplexity", _millionths("heatIntensity")
    )


@query("heatmap_regions")
def _(spark, sf):
    return heat.heatmap_regions(code(spark, sf)).select(
        "file_id", "ord", "name", "startLine", "endLine", _millionths("intensity"), "complexity", "color"
    )


@query("heat_lines")
def _(spark, sf):
    return heat.heat_lines(code(spark, sf)).select("file_id", "ord", "line", "color")


@query("heat_overlay")
def _(spark, sf):
    return heat.heat_overlay(code(spark, sf)).select(
        "file_id", "line", "name", "color", _millionths("alpha")
    )


@query("heat_color")
def _(spark, sf):
    return heat.heat_overlay(code(spark, sf)).select("file_id", "line", "r", "g", "b")


@query("badge_rows")
def _(spark, sf):
    return heat.badge_rows(code(spark, sf))


# -- lint and refactoring -----------------------------------------------------
def flat_issues(df: DataFrame, *keys: str) -> DataFrame:
    """The missing end line is shown as 0."""
    return df.select(
        "file_id", *keys, "type", "rule", "message", "line", "severity",
        F.coalesce("endLine", F.lit(0)).alias("endLine"),
    )


def _lint_query(name: str, rule: str) -> None:
    QUERIES[name] = lambda spark, sf: flat_issues(
        analysis.lint_rule(code(spark, sf), rule), "ord"
    )


for _name, _rule in {
    "lint_function_length": "length",
    "lint_nesting": "nesting",
    "lint_params": "params",
    "lint_returns": "returns",
    "lint_complexity": "complexity",
}.items():
    _lint_query(_name, _rule)


@query("lint_large_switch")
def _(spark, sf):
    return flat_issues(analysis.lint_large_switch(code(spark, sf)))


@query("lint_duplicate")
def _(spark, sf):
    return flat_issues(analysis.lint_duplicate(code(spark, sf)), "i", "j")


@query("lint_all")
def _(spark, sf):
    return flat_issues(analysis.lint_all(code(spark, sf)), "issue_ord")


@query("lint_all_service")
def _(spark, sf):
    return flat_issues(analysis.lint_all(code(spark, sf), "service"), "issue_ord")


@query("lint_all_custom_limits")
def _(spark, sf):
    limits = {"loc": 30, "nesting": 2, "params": 4, "cc": 8}
    return flat_issues(analysis.lint_all(code(spark, sf), "service", limits), "issue_ord")


SUGGESTION = ("function", "line", "type", "priority", "title", "description", "pattern")


def _refactor_query(name: str, rule: str) -> None:
    QUERIES[name] = lambda spark, sf: analysis.refactor_rule(code(spark, sf), rule).select(
        "file_id", "ord", *SUGGESTION
    )


for _name, _rule in {
    "refactor_decompose": "decompose",
    "refactor_param_object": "param_object",
    "refactor_extract": "extract",
    "refactor_flatten": "flatten",
}.items():
    _refactor_query(_name, _rule)


@query("lint_all_core_limits")
def _(spark, sf):
    limits = {"loc": "30 lines", "nesting": "0", "params": "abc", "cc": "99999999999"}
    return flat_issues(analysis.lint_all(code(spark, sf), thresholds=limits), "issue_ord")


@query("refactor_all")
def _(spark, sf):
    return analysis.refactor_all(code(spark, sf)).select("file_id", "ord", *SUGGESTION)


@query("refactor_all_service")
def _(spark, sf):
    return analysis.refactor_all(code(spark, sf), "service").select("file_id", "ord", *SUGGESTION)


def _part(items: str, kind: str, text) -> Column:
    return F.transform(
        items,
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("ord"), text(x).alias("text")
        ),
    )


def _told(found: DataFrame, kind: str, field: str, *others: Column) -> DataFrame:
    """Rows (file_id, kind, ord, text) of a field of the findings and of such arrays."""
    def told(issue: E.Expr, place: E.Expr) -> E.Expr:
        return E.struct(E.lit(kind).alias("kind"), place.alias("ord"), issue[field].alias("text"))

    rows = analysis.spread(found.withColumn("others", F.concat(*others)), told, E.col("others"))
    return rows.select("file_id", "x.*")


@query("issue_message")
def _(spark, sf):
    return _told(
        analysis.with_findings(code(spark, sf)), "issue", "message",
        _part("refactorSuggestions", "advice", lambda x: x["description"]),
    )


@query("thresholds_resolve")
def _(spark, sf):
    raw = (
        F.when(F.col("p_size") % 5 == 0, F.lit("none"))
        .when(F.col("p_size") % 5 == 1, F.concat(F.lit(" "), "p_size", F.lit(" lines")))
        .when(F.col("p_size") % 5 == 2, F.lit("0"))
        .when(
            F.col("p_size") % 5 == 3,
            F.when(F.col("p_size") % 2 == 0, F.lit("")).otherwise(
                F.concat(F.lit("99999999"), "p_size", F.lit("x"))
            ),
        )
        .otherwise((-F.col("p_size")).cast("string"))
    )
    return (
        table(spark, sf, "part")
        .select("p_partkey", raw.alias("raw"))
        .select(
            "p_partkey",
            *(
                findings.resolve_limit(E.col("raw"), k).alias(f"max_{k}").column
                for k in ("loc", "nesting", "params", "cc")
            ),
        )
    )


@query("display_attrs")
def _(spark, sf):
    found = analysis.with_findings(code(spark, sf))
    badge = display.file_badge(F.col("filename"), F.col("language"))
    colors = F.concat_ws(
        "/",
        display.issue_count_color(analysis.issue_count().column),
        display.suggestion_count_color(F.size("refactorSuggestions")),
    )
    counts = F.struct(F.lit("counts").alias("kind"), F.lit(0).alias("ord"), colors.alias("text"))
    told = _told(
        found, "icon", "severity",
        _part("refactorSuggestions", "color", lambda x: display.priority_color(x["priority"])),
        _part(
            "fns", "label",
            lambda f: F.concat_ws(
                "/", badge, display.function_label(f["startLine"], f["loc"], f["paramCount"])
            ),
        ),
        F.array(counts),
    )
    icon = display.severity_icon(F.col("text"))
    return told.select(
        "file_id", "kind", "ord",
        F.when(F.col("kind") == "icon", icon).otherwise(F.col("text")).alias("shown"),
    )


# -- whole results ------------------------------------------------------------
@query("file_counts")
def _(spark, sf):
    return analysis.file_counts(code(spark, sf))


def _listed(column: str, *fields: str) -> Column:
    """An array of structs as one text: fields by ':', items by newline."""
    text = E.array_join(
        E.transform(
            E.col(column),
            lambda x: E.concat_ws(":", *(E.Expr(f.replace("@", x.text)) for f in fields)),
        ),
        "\n",
    )
    return text.alias(column).column


def _cents(field: str) -> str:
    return f"cast(floor(@.{field} * 100 + 0.5D) as bigint)"


def flat_analysis(df: DataFrame) -> DataFrame:
    return df.select(
        "file_id",
        "filename",
        "language",
        "summary.loc",
        "summary.sloc",
        "summary.functionCount",
        "summary.cyclomaticComplexity",
        "summary.maintainabilityIndex",
        F.col("summary.halstead.effort").alias("effort"),
        _listed(
            "functions", "@.name", "@.startLine", "@.endLine", "array_join(@.params, '|')",
            "@.cyclomaticComplexity", "@.complexityLevel.color", _cents("halstead.volume"),
            _cents("maintainabilityIndex"), "@.maxNestingDepth",
        ),
        _listed(
            "linterIssues", "@.type", "@.rule", "@.message", "@.line", "@.severity",
            "coalesce(@.endLine, 0)",
        ),
        _listed(
            "refactorSuggestions", "@.function", "@.line", "@.type", "@.priority", "@.title",
            "@.description", "@.pattern",
        ),
        _listed(
            "heatmap", "@.name", "@.startLine", "@.endLine", _cents("intensity"), "@.complexity",
            "@.color",
        ),
    )


@query("analysis_result")
def _(spark, sf):
    return flat_analysis(analysis.analyze(code(spark, sf)))


@query("analysis_result_service")
def _(spark, sf):
    return flat_analysis(analysis.analyze(code(spark, sf), "service"))


@query("result_json")
def _(spark, sf):
    return analysis.result_json(analysis.analyze(code(spark, sf)))


# -- history and latest values ------------------------------------------------
def shown_history(df: DataFrame) -> DataFrame:
    return df.select(
        *(c for c in history.RECORD_FIELDS if c != "timestamp"),
        history.iso_utc(F.col("timestamp")).alias("timestamp"),
    )


@query("history_append")
def _(spark, sf):
    path = fresh_folder(spark, "history")
    records = history.history_records(analysis.analyze(code(spark, sf)), analysed_at())
    history.append_history(records, path)
    return shown_history(history.read_history(spark, path))


@query("history_top50")
def _(spark, sf):
    path = fresh_folder(spark, "history-days")
    records = history.history_records(analysis.analyze(code(spark, sf)), analysed_at())
    history.append_history(records, path)
    return shown_history(history.newest_history(spark, path))


@query("latest_analysis")
def _(spark, sf):
    return history.latest(
        table(spark, sf, "events"), "user_id", ["event_id", "event_type", "value"], ["ts", "event_id"]
    )


@query("current_or_last")
def _(spark, sf):
    events = table(spark, sf, "events")
    return history.current_or_last(
        events.filter(F.col("event_type") == "view"), events, "user_id", "value", ["ts", "event_id"]
    )


def day_of_event() -> Column:
    return F.to_date("ts")


@query("change_only")
def _(spark, sf):
    return history.change_only(
        table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"),
        "user_id", "event_type", ["ts", "event_id"], day_of_event(),
    ).select("user_id", "event_id", "event_type")


# -- streaming ----------------------------------------------------------------
EVENT_DDL = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"
DOCUMENT_DDL = "doc_id bigint, text string"


@query("stream_analyze")
def _(spark, sf):
    arriving = jobs.stream_table(spark, f"{sf}/documents.parquet", DOCUMENT_DDL)
    path = fresh_folder(spark, "stream-history")
    jobs.stream_analyze(
        corpora.documents_as_files(arriving),
        path,
        fresh_folder(spark, "stream-history-checkpoint"),
        analysed_at(),
    ).awaitTermination()
    return shown_history(history.read_history(spark, path))


@query("stream_latest")
def _(spark, sf):
    path = fresh_folder(spark, "stream-latest")
    values, order = ["event_type", "value"], ["ts", "event_id"]
    jobs.stream_latest(
        jobs.stream_table(spark, f"{sf}/events.parquet", EVENT_DDL),
        "user_id", values, order, path, fresh_folder(spark, "stream-latest-checkpoint"),
    ).awaitTermination()
    return jobs.read_latest(
        spark, path, "user_id", ["event_id", *values], order,
        "user_id bigint, ts timestamp, event_id bigint, event_type string, value double",
    )


@query("stream_change_only")
def _(spark, sf):
    path = fresh_folder(spark, "stream-changes")
    columns = ["user_id", "ts", "event_id", "event_type"]
    jobs.stream_change_only(
        jobs.stream_table(spark, f"{sf}/events.parquet", EVENT_DDL).select(*columns),
        "user_id", "event_type", ["ts", "event_id"], day_of_event(),
        path, fresh_folder(spark, "stream-changes-checkpoint"),
    ).awaitTermination()
    return jobs.read_changes(
        spark, path, ["user_id", "event_id", "event_type"], "user_id bigint, event_id bigint, event_type string"
    )
