"""Reads of a code base as named table functions, for spark.sql.

``register`` binds them to DataFrames; each is then called by name, alone or for every row of a table:

    SELECT * FROM inspect_callers('Client.send')
    SELECT s.symbol, c.* FROM symbols s, LATERAL inspect_callers(s.symbol) c

They are SQL, so Catalyst plans a lateral call of the inspecting functions as an equi-join with a rank. Their limits are the tools' own: each answers with its
first rows in a stated order. The searches of lines and names match by content and end in a limit: they are for one call each, not for lateral calls. Without its table, a function reads an empty one.
Tables of parsed sources are to be written first (sources.tables.written): a parse is not to be repeated for each call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernstone.sources import code

#: The tables behind the functions.
TABLES = {
    "files": "path string, code string",
    "lines": "path string, line_no long, line string",
    "nodes": "id string, name string, kind string, path string, start_line int, end_line int, signature string, docstring string",
    "edges": "src string, dst string, kind string",
    "tests": "id string, name string, path string, start_line int, end_line int, symbols array<string>",
    "commits": "path string, commit string, day string, author string, subject string, seq long",
}
#: How many rows each group of tools gives.
MATCHES, SYMBOLS, RELATIONS, TESTS, COMMITS = 15, 10, 15, 10, 5

_PLACE = "n.name, n.path AS file, n.start_line AS line, n.signature, n.id"
_PLACES = "name STRING, file STRING, line INT, signature STRING, id STRING"


def _first(source: str, key: str, columns: str, order: str, most: int) -> str:
    """The first rows of each key, for the key given. A rank within the key, not a limit, so that a call for each row of a table ranks each of its keys."""
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS _r FROM ({source})) WHERE {key} = symbol AND _r <= {most}"


def _related(edges: str, kinds: str = "") -> str:
    """Nodes at the other end of the symbol's edges, by name and id."""
    source = f"SELECT DISTINCT o.key, {_PLACE} FROM ({edges}) e JOIN tool_named o ON e.this = o.id JOIN tool_nodes n ON e.other = n.id {kinds}"
    return _first(source, "key", "name, file, line, signature, id", "name, id", RELATIONS)


_INTO, _OUT = "SELECT dst AS this, src AS other, kind FROM tool_edges", "SELECT src AS this, dst AS other, kind FROM tool_edges"
_MATCH = "file STRING, line_number BIGINT, snippet STRING"
_LINE = "path AS file, line_no AS line_number, left(trim(line), 200) AS snippet"
_SPAN = "line_no BIGINT, line STRING"

#: name: (arguments, columns, query)
FUNCTIONS = {
    "search_code": ("query STRING", _MATCH, f"SELECT {_LINE} FROM tool_lines WHERE query <> '' AND line RLIKE query ORDER BY path, line_no LIMIT {MATCHES}"),
    "search_exact": ("literal STRING", _MATCH, f"SELECT {_LINE} FROM tool_lines WHERE literal <> '' AND contains(line, literal) ORDER BY path, line_no LIMIT {MATCHES}"),
    "find_symbol": ("symbol STRING", "symbol STRING, type STRING, file STRING, line_start INT, line_end INT", f"""SELECT n.name AS symbol, CASE WHEN n.kind = 'CLASS' THEN 'class' ELSE 'function' END AS type, n.path AS file, n.start_line AS line_start, n.end_line AS line_end
        FROM tool_nodes n WHERE n.kind <> 'FILE' AND contains(n.name, find_symbol.symbol) ORDER BY n.name <> find_symbol.symbol, n.path, n.start_line, n.name LIMIT {SYMBOLS}"""),
    "find_references": ("symbol STRING", _MATCH, f"SELECT {_LINE} FROM tool_lines WHERE symbol <> '' AND contains(line, symbol) AND symbol RLIKE '^[A-Za-z0-9_.]+$' AND line RLIKE concat('(^|[^A-Za-z0-9_])', replace(symbol, '.', '[.]'), '([^A-Za-z0-9_]|$)') ORDER BY path, line_no LIMIT {MATCHES}"),
    "read_file": ("file STRING, first_line BIGINT, last_line BIGINT", _SPAN, "SELECT line_no, line FROM tool_lines WHERE path = file AND line_no BETWEEN first_line AND last_line"),
    "read_test": ("test STRING", _SPAN, "SELECT l.line_no, l.line FROM tool_tests t JOIN tool_lines l ON l.path = t.path AND l.line_no BETWEEN t.start_line AND t.end_line WHERE t.id = test OR t.name = test"),
    "inspect_symbol": ("symbol STRING", "id STRING, kind STRING, file STRING, line_start INT, line_end INT, signature STRING, docstring STRING", "SELECT n.id, n.kind, n.path AS file, n.start_line AS line_start, n.end_line AS line_end, n.signature, n.docstring FROM tool_nodes n JOIN tool_named o ON n.id = o.id WHERE o.key = symbol"),
    "inspect_callers": ("symbol STRING", _PLACES, _related(_INTO, "WHERE e.kind = 'CALLS'")),
    "inspect_callees": ("symbol STRING", _PLACES, _related(_OUT, "WHERE e.kind = 'CALLS'")),
    "inspect_hierarchy": ("symbol STRING", _PLACES, _related(f"{_INTO} UNION ALL {_OUT}", "WHERE e.kind = 'INHERITS'")),
    "inspect_references": ("symbol STRING", _PLACES, _related(f"{_INTO} UNION ALL {_OUT}")),
    "inspect_tests": ("symbol STRING", "id STRING, test STRING, file STRING, line INT", _first("SELECT explode(array_distinct(symbols)) AS key, id, name AS test, path AS file, start_line AS line FROM tool_tests", "key", "id, test, file, line", "file, line, id", TESTS)),
    "inspect_git_history": ("file STRING", "commit STRING, day STRING, author STRING, subject STRING", f"SELECT commit, day, author, subject FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS _r FROM tool_commits) WHERE path = file AND _r <= {COMMITS}"),
    "inspect_control_flow": ("file STRING, symbol STRING", "function STRING, block INT, parent INT, depth INT, kind STRING, start_line INT, end_line INT, condition STRING", "SELECT b.* FROM tool_files f, LATERAL parse_blocks(f.path, f.code) b WHERE f.path = file AND (b.function = symbol OR endswith(b.function, concat(':', symbol)) OR endswith(b.function, concat('.', symbol)))"),
    "inspect_state_flow": ("file STRING, symbol STRING", "function STRING, variable STRING, action STRING, line INT", "SELECT s.* FROM tool_files f, LATERAL parse_state(f.path, f.code) s WHERE f.path = file AND (s.function = symbol OR endswith(s.function, concat(':', symbol)) OR endswith(s.function, concat('.', symbol)))"),
    "inspect_failure": ("log STRING", "depth INT, file STRING, line INT, function STRING, symbol STRING", """SELECT f.depth, f.file, f.line, f.function, n.id AS symbol FROM
        (SELECT pos + 1 AS depth, regexp_extract(frame, '"([^"]+)"', 1) AS file, CAST(regexp_extract(frame, 'line ([0-9]+)', 1) AS INT) AS line, regexp_extract(frame, ', in ([A-Za-z0-9_<>.]+)', 1) AS function
         FROM (SELECT posexplode(regexp_extract_all(log, 'File "[^"]+", line [0-9]+, in [A-Za-z0-9_<>.]+', 0)) AS (pos, frame))) f
        LEFT JOIN tool_nodes n ON n.name = f.function AND endswith(f.file, n.path) AND f.line BETWEEN n.start_line AND n.end_line"""),
}


def register(spark: SparkSession, **tables: DataFrame) -> list[str]:
    """Binds the functions to the tables given (see TABLES; lines follow from files where only those are given) and returns their names."""
    code.register(spark)
    if "lines" not in tables and "files" in tables:
        tables["lines"] = tables["files"].selectExpr("path", "posexplode(split(code, '\\n', -1)) AS (n, line)").selectExpr("path", "CAST(n + 1 AS BIGINT) AS line_no", "line")
    for name, schema in TABLES.items():
        df = tables.get(name)
        df = spark.createDataFrame([], schema) if df is None else df
        missing = [f"CAST(NULL AS {c.dataType.simpleString()}) AS {c.name}" for c in spark.createDataFrame([], schema).schema if c.name not in df.columns]
        df.selectExpr("*", *missing).createOrReplaceTempView(f"tool_{name}")
    # a symbol's id and its name lead to it, by equality, so that a lateral call is an equi-join
    spark.sql("SELECT id AS key, id FROM tool_nodes UNION ALL SELECT name, id FROM tool_nodes WHERE name <> id").createOrReplaceTempView("tool_named")
    for name, (arguments, columns, query) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE ({columns}) RETURN {query}")
    return list(FUNCTIONS)
