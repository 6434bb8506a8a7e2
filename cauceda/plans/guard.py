"""Read-only SQL over allowed tables. Spark's own parser reads the text; this module only looks at what it made.

Everything is an allow-list: kinds of nodes, kinds of expressions, table names, and functions: the engine's own ones
by their plain names, without those that leave the engine or tell about it.
Names are checked where they stand, so that a CTE hides a table only in the query that declares it. The query then
runs in a session that holds nothing but the allowed views.
"""

from __future__ import annotations

import re
import threading
import uuid
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from cauceda.functions import naming

#: Relations and their containers that a read-only query is made of.
NODES = frozenset(
    "Project Filter Aggregate Join Sort GlobalLimit LocalLimit Limit Offset Distinct Union Intersect Except SubqueryAlias UnresolvedRelation "
    "UnresolvedWith UnresolvedSubqueryColumnAliases UnresolvedHaving UnresolvedInlineTable LocalRelation OneRowRelation WithWindowDefinition "
    "UnresolvedOrderBy LateralJoin Pivot Unpivot Window Generate RepartitionByExpression Tail UnresolvedTableAlias ResolvedInlineTable".split()
)
#: What an expression of such a query is made of, as the parser names it.
EXPRESSIONS = frozenset(
    "UnresolvedAttribute UnresolvedStar UnresolvedStarExcept UnresolvedFunction UnresolvedAlias MultiAlias Alias Literal UnresolvedExtractValue UnresolvedOrdinal "
    "And Or Not EqualTo EqualNullSafe LessThan LessThanOrEqual GreaterThan GreaterThanOrEqual In InSubquery ListQuery Exists ScalarSubquery LateralSubquery "
    "IsNull IsNotNull IsUnknown IsNotUnknown Add Subtract Multiply Divide Remainder IntegralDivide UnaryMinus UnaryPositive BitwiseAnd BitwiseOr BitwiseXor BitwiseNot "
    "CaseWhen If Coalesce Cast Concat Like ILike RLike LikeAll LikeAny NotLikeAll NotLikeAny Between SortOrder NamedArgumentExpression "
    "WindowExpression UnresolvedWindowExpression WindowSpecDefinition SpecifiedWindowFrame UnspecifiedFrame$ CurrentRow$ UnboundedPreceding$ UnboundedFollowing$ "
    "CurrentDate CurrentTimestamp LocalTimestamp Now CurrentTimeZone Extract TimestampAdd TimestampDiff DateAdd DateSub "
    "Substring StringTrim StringTrimLeft StringTrimRight StringTrimBoth StringLocate Overlay CreateNamedStruct CreateStruct UnresolvedNamedLambdaVariable LambdaFunction "
    "GroupingSets Cube Rollup BaseGroupingSets First Last AnyValue Collate UnresolvedCollation".split()
)
#: With this set a text in double quotes is a name, as in other dialects.
QUOTED = "spark.sql.ansi.doubleQuotedIdentifiers"
FORBIDDEN_FUNCTIONS = frozenset(
    "java_method reflect try_reflect input_file_name input_file_block_start input_file_block_length raise_error assert_true sleep current_user session_user user current_catalog current_database current_schema version "
    "spark_partition_id monotonically_increasing_id from_avro to_avro from_protobuf to_protobuf schema_of_avro http_request try_http_request".split()
)


@dataclass
class Verdict:
    ok: bool
    reason: str = ""
    tables: set[str] = field(default_factory=set)


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _walk(node, hidden: frozenset, found: set[str], problems: list[str]) -> None:
    kind = node.getClass().getSimpleName()
    if kind not in NODES:
        problems.append(f"{kind} is not part of a read-only query")
        return
    if kind == "UnresolvedRelation":
        parts = _items(node.multipartIdentifier())
        if len(parts) > 1:
            problems.append(f"{'.'.join(parts)}: names with a schema are not allowed")
        elif parts[0].lower() not in hidden:
            found.add(parts[0].lower())
        return
    if kind == "UnresolvedWith":
        seen = hidden
        for pair in _items(node.cteRelations()):
            _walk(pair._2(), seen, found, problems)  # a CTE sees those before it, not itself
            seen = seen | {pair._1().lower()}
        _walk(node.child(), seen, found, problems)
        return
    for expression in _items(node.expressions()):
        _expressions(expression, hidden, found, problems)
    for child in _items(node.children()):
        _walk(child, hidden, found, problems)


def _expressions(node, hidden: frozenset, found: set[str], problems: list[str]) -> None:
    kind = node.getClass().getSimpleName()
    if kind not in EXPRESSIONS:
        problems.append(f"{kind} is not part of a read-only query")
        return
    if kind == "UnresolvedAttribute":
        # without a column of the name, the analyser takes these for functions, with or without parentheses
        parts = [x.lower() for x in _items(node.nameParts())]
        if len(parts) == 1 and parts[0] in FORBIDDEN_FUNCTIONS:
            problems.append(f"the name {parts[0]} is not allowed")
    if kind == "UnresolvedFunction":
        parts = [x.lower() for x in _items(node.nameParts())]
        if len(parts) > 1 or parts[0] in FORBIDDEN_FUNCTIONS or parts[0] not in _functions(SparkSession.active()):
            problems.append(f"the function {'.'.join(parts)} is not allowed")
    if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
        _walk(node.plan(), hidden, found, problems)
    for child in _items(node.children()):
        _expressions(child, hidden, found, problems)


@lru_cache(1)
def _functions(spark: SparkSession) -> frozenset[str]:
    """The engine's own functions, without those that users or tables of a catalog add."""
    return frozenset(r[0].lower() for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect())


def check(spark: SparkSession, sql: str, tables: set[str]) -> Verdict:
    """Whether ``sql`` is one read-only query over ``tables`` that reads at least one of them."""
    text = re.sub(r";\s*$", "", sql.strip())
    own = spark.newSession()  # the caller's settings stay as they are, whatever other threads do
    own.conf.set(QUOTED, "true")
    sessions = spark._jvm.org.apache.spark.sql.classic.SparkSession
    sessions.setActiveSession(own._jsparkSession)  # of this thread: a parser reads the active session's settings
    try:
        plan = own._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as error:  # the parser's own message is the reason
        return Verdict(False, f"it cannot be read: {' '.join(str(error).split())[:200]}")
    finally:
        sessions.setActiveSession(spark._jsparkSession)
    found: set[str] = set()
    problems: list[str] = []
    _walk(plan, frozenset(), found, problems)
    if problems:
        return Verdict(False, problems[0], found)
    if outside := found - {t.lower() for t in tables}:
        return Verdict(False, f"not among the allowed tables: {', '.join(sorted(outside))}", found)
    return Verdict(True, tables=found) if found else Verdict(False, "it reads no table")


#: How a question asks for a period and how a query groups by one.
ASKED = {"month": r"\b(mes\s+a\s+mes|por\s+mes|mensual(mente)?)\b", "week": r"\b(semana\s+a\s+semana|por\s+semana|semanal(mente)?)\b"}
GROUPED = {"month": r"date_trunc\s*\(\s*['\"]month['\"]|\bmensual\b|\bas\s+mes\b", "week": r"date_trunc\s*\(\s*['\"]week['\"]|\bsemana\b|\bas\s+sem\b"}


def fits_period(question: str, sql: str) -> bool:
    """A question by month is not answered by week, nor the other way round."""
    asked, query = naming.plain(question).lower(), sql.lower()
    return not any(re.search(ASKED[a], asked) and re.search(GROUPED[b], query) for a, b in (("month", "week"), ("week", "month")))


def session_of(spark: SparkSession, views: dict[str, DataFrame], zone: str = "UTC") -> SparkSession:
    """A session with the views and nothing else; text in double quotes names a column, as in other dialects.

    A plan belongs to the session it was made in. It passes to the new one as a view of global scope, whose name
    nobody can guess and which the new session's view stands for.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", zone)
    own.conf.set(QUOTED, "true")
    for name, df in views.items():
        passed = f"v{uuid.uuid4().hex}"
        df.createGlobalTempView(passed)
        try:
            own.table(f"global_temp.{passed}").createTempView(name)
        finally:  # the new view holds the plan itself
            spark.catalog.dropGlobalTempView(passed)
    return own


def run(spark: SparkSession, views: dict[str, DataFrame], sql: str, limit: int = 500, timeout: float = 8.0, zone: str = "UTC") -> tuple[list[str], list[tuple]]:
    """Columns and at most ``limit`` rows of a checked query over ``views``. It is stopped after ``timeout`` seconds."""
    verdict = check(spark, sql, set(views))
    if not verdict.ok:
        raise PermissionError(verdict.reason)
    group = f"governed-{uuid.uuid4().hex}"
    own = session_of(spark, views, zone)
    spark.sparkContext.setJobGroup(group, sql[:80], True)
    timer = threading.Timer(timeout, spark.sparkContext.cancelJobGroup, [group])
    timer.start()
    try:
        out = own.sql(re.sub(r";\s*$", "", sql.strip())).limit(limit)
        return out.columns, [tuple(r) for r in out.collect()]
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def answer(spark: SparkSession, views: dict[str, DataFrame], question: str, propose, limit: int = 500, timeout: float = 8.0) -> tuple[str, list[str], list[tuple]]:
    """(sql, columns, rows) of a proposed query. ``propose(question, reason)`` is asked once more with the reason for
    which its first query was refused or failed; a second refusal raises PermissionError."""
    reason = ""
    for _ in range(2):
        sql = propose(question, reason)
        verdict = check(spark, sql, set(views))
        if not verdict.ok:
            reason = verdict.reason
        elif not fits_period(question, sql):
            reason = "the question and the query are of different periods"
        else:
            try:
                return sql, *run(spark, views, sql, limit, timeout)
            except Exception as error:  # Spark's own message is the reason
                reason = " ".join(str(error).split())[:200]
    raise PermissionError(reason)


def last_valid(spark: SparkSession, history: list[str], tables: set[str]) -> str | None:
    """The newest query of a conversation that is still admitted, for a question that only follows it up."""
    return next((sql for sql in reversed(history) if sql and check(spark, sql, tables).ok), None)


def canonical(spark: SparkSession, views: dict[str, DataFrame], formula: str) -> DataFrame:
    """A KPI's formula over the logical names of its tables. The views carry those names, so nothing is rewritten."""
    verdict = check(spark, formula, set(views))
    if not verdict.ok:
        raise PermissionError(verdict.reason)
    return session_of(spark, views).sql(formula)
