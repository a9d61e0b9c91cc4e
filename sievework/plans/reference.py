"""Queries for the reference's own operators, over the whole tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import replies as R

from ..operators import dedup, detect, modules, order, regions, schedule, search, summaries, verify
from ..session import table
from ..sources import sinks

PREFIXES = ["net", "sync", "alloc"]
BUDGET = 50_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# what several of the SQL texts share
KIND = """CASE WHEN lower(coalesce(invariant_type, '')) IN ('temporal_ordering', 'resource_lifecycle', 'state_machine', 'precondition', 'protocol') THEN lower(invariant_type)
  WHEN regexp_matches(lower(coalesce(invariant_type, '')), 'temporal|order|sequence') THEN 'temporal_ordering'
  WHEN regexp_matches(lower(coalesce(invariant_type, '')), 'resource|lifecycle|cleanup') THEN 'resource_lifecycle'
  WHEN regexp_matches(lower(coalesce(invariant_type, '')), 'state|machine') THEN 'state_machine'
  WHEN regexp_matches(lower(coalesce(invariant_type, '')), 'precondition|require') THEN 'precondition' ELSE 'protocol' END"""
CONF = r"CASE WHEN lower(regexp_replace(coalesce(confidence, ''), '^\s+|\s+$', '', 'g')) IN ('high', 'low') THEN lower(regexp_replace(confidence, '^\s+|\s+$', '', 'g')) ELSE 'medium' END"
COUNTS = ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in C.KINDS)
WEIGHED = f"""w AS (SELECT id, coalesce(entity, '') AS entity, {KIND} AS kind, coalesce(title, '') AS title,
  CASE {CONF} WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS rank,
  CAST(coalesce(octet_length(encode(evidence.code_snippet)), 0) AS INTEGER) AS bytes FROM invariants WHERE id IS NOT NULL),
x AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY trim(regexp_replace(lower(entity), '\\s+', ' ', 'g')), trim(regexp_replace(lower(title), '\\s+', ' ', 'g')), kind ORDER BY rank DESC, bytes DESC, id) = 1)"""
FUZZY = f"""WITH {WEIGHED},
s AS (SELECT *, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(title), '\\s+'), lambda y: y <> ''))) AS ws FROM x),
g AS (SELECT lower(entity) AS e, kind AS k, list([{{'id': id, 'ws': ws}}] ORDER BY rank DESC, bytes DESC, id) AS l FROM s GROUP BY 1, 2),
kept AS (SELECT unnest(list_reduce(l, lambda a, b: CASE WHEN len(list_filter(a, lambda y: len(y.ws) + len(b[1].ws) > 0 AND len(list_intersect(y.ws, b[1].ws)) * 1.0 / len(list_distinct(list_concat(y.ws, b[1].ws))) > 0.6)) > 0 THEN a ELSE list_concat(a, b) END)) AS f FROM g)
"""
LINES = r"regexp_split_to_array(regexp_replace(replace(raw_source, chr(13) || chr(10), chr(10)), '\n\z', ''), '\n')"
DONE = r"SELECT DISTINCT crate_name, module_path AS chunk_id FROM progress WHERE lower(regexp_replace(status, '^\s+|\s+$', '', 'g')) = 'completed' AND module_path IS NOT NULL"
HIT = "(" + " OR ".join(f"contains(coalesce(module_path, ''), '{p}')" for p in PREFIXES) + ")"
MOD = r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+([^\s;{]+)"
HEAD = r"^(pub(?:\([^)]*\))?\s+)?(?:default\s+|async\s+|unsafe\s+|const\s+)*(fn|struct|enum|trait|impl|mod|type|static|const|union)\b\s*(?:<[^>]*>\s*)?([A-Za-z_][A-Za-z0-9_:]*)?"
NUMBERED_LINES = f"""t AS (SELECT crate_name, chunk_id, {LINES} AS ls FROM chunks WHERE raw_source IS NOT NULL),
l AS (SELECT crate_name, chunk_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS no FROM t)"""
TREE = f"""{NUMBERED_LINES}, m AS (SELECT DISTINCT crate_name, module_path AS module FROM chunks WHERE crate_name IS NOT NULL AND module_path IS NOT NULL),
d AS (SELECT DISTINCT c.crate_name, c.module_path AS parent, regexp_extract(l.line, '{MOD}', 1) AS sub FROM l JOIN chunks c ON c.crate_name = l.crate_name AND c.chunk_id = l.chunk_id WHERE c.module_path IS NOT NULL),
c AS (SELECT DISTINCT d.crate_name, d.parent, m.module FROM d JOIN m ON m.crate_name = d.crate_name AND m.module = CASE WHEN d.parent = 'crate' THEN d.sub ELSE d.parent || '::' || d.sub END WHERE d.sub NOT IN ('', 'tests')
  UNION SELECT m.crate_name, p.module, m.module FROM m JOIN m p ON p.crate_name = m.crate_name AND p.module = CASE WHEN contains(m.module, '::') THEN regexp_replace(m.module, '::[^:]*$', '') ELSE 'crate' END WHERE m.module <> 'crate')"""
METHOD = r"^\s+(?:pub(?:\([^)]*\))?\s+)?(?:default\s+|async\s+|unsafe\s+|const\s+)*fn\s+([A-Za-z_][A-Za-z0-9_]*)"
FIELD = r"^\s+(?:pub(?:\([^)]*\))?\s+)?([a-z_][A-Za-z0-9_]*):\s*([^,]*),?\s*$"
VARIANT = r"^\s+([A-Z][A-Za-z0-9_]*)"
UNSAFE = r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:default\s+|async\s+|const\s+)*unsafe\s+(?:extern\s+\S+\s+)?fn\b"
TARGET = r"^impl\b\s*(?:<[^>]*>\s*)?(?:([^{]*?)\s+for\s+)?([^{]*)"
SIZE = "CAST(octet_length(encode({})) AS BIGINT)"
ITEMS = rf"""{NUMBERED_LINES},
q AS (SELECT *, regexp_matches(line, '{HEAD}') AS head, starts_with(line, '///') AS doc, regexp_matches(line, '{METHOD}') AS method FROM l),
k AS (SELECT *, sum(CAST(head AS INTEGER)) OVER (PARTITION BY crate_name, chunk_id ORDER BY no) + CAST(doc AS INTEGER) AS place FROM q),
g AS (SELECT crate_name, chunk_id, place, min(no) FILTER (head) AS line_no, max(line) FILTER (head) AS line, CAST(sum(CAST(method AS INTEGER)) AS INTEGER) AS methods,
  bool_or(method AND regexp_matches(line, '\((?:mut )?self\b')) AS owned, bool_or(regexp_matches(line, '{UNSAFE}')) AS unsafe, bool_or(contains(line, 'PhantomData')) AS phantom,
  sum(CASE WHEN regexp_matches(line, '{FIELD}') THEN {SIZE.format(f"regexp_extract(line, '{FIELD}', 1)")} + {SIZE.format(f"trim(regexp_extract(line, '{FIELD}', 2))")} + 4 ELSE 0 END) AS field,
  sum(CASE WHEN regexp_matches(line, '{VARIANT}') THEN {SIZE.format(f"regexp_extract(line, '{VARIANT}', 1)")} + 10 ELSE 0 END) AS variant,
  sum(CASE WHEN method THEN {SIZE.format(f"regexp_extract(line, '{METHOD}', 1)")} + 10 ELSE 0 END) AS named, sum(CASE WHEN doc THEN {SIZE.format("trim(substr(line, 4))")} ELSE 0 END) AS doc_size,
  sum(CASE WHEN NOT head AND NOT doc THEN {SIZE.format("trim(line)")} ELSE 0 END) AS line_size FROM k WHERE place > 0 GROUP BY 1, 2, 3),
h AS (SELECT *, regexp_extract(line, '{HEAD}', 2) AS kind, regexp_extract(line, '{HEAD}', 3) AS name, trim(regexp_extract(line, '{TARGET}', 1)) AS tr, trim(regexp_extract(line, '{TARGET}', 2)) AS tg, trim(regexp_extract(line, '^[^{{;]*')) AS signature FROM g WHERE line IS NOT NULL),
items AS (SELECT crate_name, chunk_id, CAST(place AS BIGINT) AS place, CAST(line_no AS INTEGER) AS line_no, kind, name, CASE WHEN kind = 'impl' AND tr <> '' THEN tr END AS trait, CASE WHEN kind = 'impl' THEN tg END AS target, signature, methods, owned, unsafe, phantom,
  CAST(CASE kind WHEN 'struct' THEN {SIZE.format("name")} + field + 20 + doc_size WHEN 'enum' THEN {SIZE.format("name")} + variant + 20 + doc_size WHEN 'fn' THEN {SIZE.format("signature")} + 20 + doc_size + line_size WHEN 'trait' THEN {SIZE.format("name")} + named + 20 ELSE {SIZE.format("tg")} + 20 + 20 * methods + line_size END AS BIGINT) AS chars
  FROM h WHERE kind IN ('struct', 'enum', 'fn', 'trait', 'impl') AND NOT (kind = 'impl' AND regexp_replace(trim(regexp_replace(tr, '<.*$', '')), '^.*::', '') IN ('Debug', 'Clone', 'Copy', 'Default', 'Display', 'PartialEq', 'Eq', 'Hash', 'PartialOrd', 'Ord')))"""
CLUSTERS = f"""{ITEMS},
an AS (SELECT crate_name, chunk_id, place, name, row_number() OVER (PARTITION BY crate_name, chunk_id ORDER BY kind = 'enum', place) - 1 AS n FROM items WHERE kind IN ('struct', 'enum')),
top AS (SELECT crate_name, chunk_id, count(*) AS n FROM an GROUP BY 1, 2),
cl AS (SELECT i.*, min(a.n) AS c FROM items i LEFT JOIN an a ON a.crate_name = i.crate_name AND a.chunk_id = i.chunk_id AND ((i.kind IN ('struct', 'enum') AND a.place = i.place) OR (i.kind = 'impl' AND contains(i.target, a.name)) OR (i.kind = 'fn' AND contains(i.signature, a.name))) GROUP BY ALL),
cn AS (SELECT cl.*, coalesce(cl.c, top.n, 0) AS cluster, CASE WHEN kind IN ('struct', 'enum', 'trait') THEN kind || ' ' || name WHEN kind = 'impl' THEN 'impl ' || coalesce(trait || ' for ', '') || target || ' (' || methods || ' methods)' END AS word FROM cl LEFT JOIN top ON top.crate_name = cl.crate_name AND top.chunk_id = cl.chunk_id),
cs AS (SELECT crate_name, chunk_id, CAST(cluster AS INTEGER) AS cluster, count(*) FILTER (kind IN ('struct', 'enum')) AS types, count(*) FILTER (kind = 'trait') AS traits, count(*) FILTER (kind = 'fn') AS functions, count(*) FILTER (kind = 'impl') AS impls, sum(methods) AS ms, sum(chars) AS chars,
  concat_ws(', ', string_agg(word, ', ' ORDER BY kind = 'trait', place) FILTER (kind IN ('struct', 'enum', 'trait')), CASE WHEN count(*) FILTER (kind = 'fn') > 0 THEN count(*) FILTER (kind = 'fn') || ' free function(s)' END, string_agg(word, ', ' ORDER BY place) FILTER (kind = 'impl')) AS summary FROM cn GROUP BY 1, 2, 3),
clusters AS (SELECT s.crate_name, s.chunk_id, s.cluster, a.name AS anchor, types, traits, functions, impls, summary, CAST(chars // 4 AS BIGINT) AS tokens FROM cs s LEFT JOIN an a ON a.crate_name = s.crate_name AND a.chunk_id = s.chunk_id AND a.n = s.cluster WHERE types + traits + functions > 0 OR ms > 0)"""


# --- findings: summaries, classes, duplicates

@query(f"{FUZZY} SELECT count(*) AS total, {COUNTS} FROM kept JOIN x ON x.id = kept.f.id")
def findings_summary(s, d):
    """Findings by kind once exact and fuzzy duplicates are gone."""
    return summaries.by_kind(dedup.fuzzy(dedup.exact(table(s, d, "invariants"))), F.col("kind"))


@query(f"WITH k AS (SELECT {KIND} AS kind FROM invariants) SELECT count(*) AS total, {COUNTS} FROM k")
def summary_by_type(s, d):
    return summaries.by_kind(table(s, d, "invariants"), C.kind_of(F.col("invariant_type")))


@query(f"WITH k AS (SELECT run_id, {CONF} AS c FROM invariants) SELECT run_id, count(*) AS findings, count(*) FILTER (c = 'high') AS high, count(*) FILTER (c = 'medium') AS medium, count(*) FILTER (c = 'low') AS low, round(count(*) FILTER (c <> 'low') * 100 / count(*), 2) AS sure_percent FROM k GROUP BY 1")
def confidence_mix(s, d):
    return summaries.confidence_mix(table(s, d, "invariants"))


@query(f"SELECT id, {KIND} AS kind, {CONF} AS confidence FROM invariants")
def classify_kind(s, d):
    return table(s, d, "invariants").select("id", C.kind_of(F.col("invariant_type")).alias("kind"), C.confidence_of(F.col("confidence")).alias("confidence"))


@query("""WITH t AS (SELECT id, lower(coalesce(suggested_pattern, '')) AS p, lower(coalesce(description, '')) AS d FROM invariants)
SELECT id, CASE WHEN regexp_matches(p, 'typestate|session') OR regexp_matches(d, 'order|sequence|before') THEN 'temporal_ordering'
  WHEN regexp_matches(p, 'raii|drop') OR regexp_matches(d, 'cleanup|free|release|close') THEN 'resource_lifecycle'
  WHEN regexp_matches(d, 'state|transition') THEN 'state_machine' WHEN regexp_matches(d, 'must|precondition|require') THEN 'precondition' ELSE 'protocol' END AS kind FROM t""")
def classify_text(s, d):
    return table(s, d, "invariants").select("id", C.kind_of_text(F.col("suggested_pattern"), F.col("description")).alias("kind"))


@query(f"""WITH t AS (SELECT id, lower(concat_ws(' ', coalesce(entity, ''), coalesce(title, ''), coalesce(description, ''))) AS all_text, lower(coalesce(entity, '')) AS e, lower(coalesce(title, '')) AS n, lower(coalesce(description, '')) AS d,
  NOT contains(coalesce(evidence.explanation, ''), '->') AS bare FROM invariants)
SELECT id, regexp_matches(all_text, '{C.COMPILE_TIME}') AS compile_time, (regexp_matches(e, 'error|result') AND regexp_matches(d, '{C.VARIANT_TALK}')) OR (contains(n, '::') AND regexp_matches(n, '( state| variant)$') AND bare) AS variant_talk FROM t""")
def noise_filter(s, d):
    e, n, x = F.col("entity"), F.col("title"), F.col("description")
    bare = ~F.coalesce("evidence.explanation", F.lit("")).contains("->")
    return table(s, d, "invariants").select("id", C.is_compile_time(e, n, x).alias("compile_time"), C.is_variant_talk(e, n, x, bare).alias("variant_talk"))


@query(f"WITH {WEIGHED} SELECT id, kind, rank, bytes FROM x")
def dedup_exact(s, d):
    return dedup.exact(table(s, d, "invariants")).select("id", "kind", "rank", "bytes")


@query(f"{FUZZY} SELECT f.id AS id FROM kept")
def dedup_fuzzy(s, d):
    return dedup.fuzzy(dedup.exact(table(s, d, "invariants"))).select("id")


@query(r"""WITH a AS (SELECT id, min(title) AS title FROM invariants GROUP BY 1), b AS (SELECT id, min(title) AS title FROM invariants_mirror GROUP BY 1),
w AS (SELECT a.id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(a.title, '')), '\s+'), lambda y: y <> '')) AS x, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(b.title, '')), '\s+'), lambda y: y <> '')) AS y FROM a JOIN b USING (id))
SELECT id, round(CASE WHEN len(x) + len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) * 1.0 / len(list_distinct(list_concat(x, y))) END, 6) AS overlap FROM w""")
def title_overlap(s, d):
    """How alike the two copies' titles of a finding are."""
    one = lambda name, as_: table(s, d, name).groupBy("id").agg(F.min("title").alias(as_))
    both = one("invariants", "a").join(one("invariants_mirror", "b"), "id")
    return both.select("id", F.round(C.overlap(C.plain_words(F.col("a")), C.plain_words(F.col("b"))), 6).alias("overlap"))


@query("SELECT run_id, count(DISTINCT location.file_path) AS files FROM invariants GROUP BY 1")
def files_per_run(s, d):
    return summaries.files_per_run(table(s, d, "invariants"))


@query(r"""WITH e AS (SELECT lower(regexp_replace(entity, '^\s+|\s+$', '', 'g')) AS e, max(CASE WHEN ends_with(run_id, '_bfs') THEN 1 ELSE 0 END) AS a, max(CASE WHEN ends_with(run_id, '_ss') THEN 1 ELSE 0 END) AS b FROM invariants WHERE trim(coalesce(entity, '')) <> '' GROUP BY 1)
SELECT count(*) FILTER (a = 1 AND b = 1) AS shared, count(*) FILTER (a = 1 AND b = 0) AS only_a, count(*) FILTER (a = 0 AND b = 1) AS only_b FROM e""")
def run_overlap(s, d):
    """Entities that breadth-first runs, search runs or both name."""
    side = F.when(F.col("run_id").endswith("_bfs"), "a").when(F.col("run_id").endswith("_ss"), "b")
    return summaries.entity_overlap(table(s, d, "invariants"), side)


# --- findings: verification

CITES = r"""WITH t AS (SELECT id, """ + CONF + r""" AS stated, coalesce(evidence.code_snippet, '') AS sn, coalesce(evidence.explanation, '') AS ex FROM invariants),
u AS (SELECT id, sn, regexp_split_to_array(regexp_replace(replace(sn, chr(13) || chr(10), chr(10)), '\n\z', ''), '\n') AS ls, CAST(unnest(regexp_extract_all(ex, 'line ([0-9]+): ([^;\n]*)', 1)) AS INTEGER) AS n, regexp_replace(unnest(regexp_extract_all(ex, 'line ([0-9]+): ([^;\n]*)', 2)), '^\s+|\s+$', '', 'g') AS c FROM t),
v AS (SELECT id, count(*) AS cited, count(*) FILTER (c <> '' AND (len(list_filter(list_slice(ls, greatest(n - 5, 1), n + 5), lambda y: contains(y, c))) > 0 OR contains(lower(sn), lower(c)))) AS verified FROM u GROUP BY 1),
r AS (SELECT t.id, stated, CAST(coalesce(cited, 0) AS INTEGER) AS cited, CAST(coalesce(verified, 0) AS INTEGER) AS verified, CASE WHEN coalesce(cited, 0) = 0 THEN 0.5 ELSE verified / cited END AS q FROM t LEFT JOIN v USING (id))
SELECT id, cited, verified, round(CAST(q AS DOUBLE), 6) AS rate, CASE WHEN q < 0.3 THEN CASE WHEN stated = 'high' THEN 'medium' ELSE 'low' END ELSE stated END AS confidence FROM r"""


@query(CITES)
def citation_rate(s, d):
    return verify.citations(table(s, d, "invariants"))


def _expected(s, d):
    f = table(s, d, "invariants_mirror").groupBy("id").agg(F.min(F.struct("location.file_path", "entity", "invariant_type")).alias("e"))
    return f.select("id", "e.file_path", "e.entity", "e.invariant_type")


ACTUAL = """WITH e AS (SELECT id, min(struct_pack(f := location.file_path, e := entity, t := invariant_type)) AS e FROM invariants_mirror GROUP BY 1),
r AS (SELECT a.id, (e.e.f IS NULL OR e.e.f IS NOT DISTINCT FROM a.location.file_path) AND (e.e.e IS NULL OR e.e.e IS NOT DISTINCT FROM a.entity) AND (e.e.t IS NULL OR e.e.t IS NOT DISTINCT FROM a.invariant_type) AS passed FROM invariants a JOIN e ON a.id = e.id)"""


@query(ACTUAL + " SELECT * FROM r")
def wildcard_compare(s, d):
    """Each finding against the mirror's as expected values, where null asks for nothing."""
    actual = table(s, d, "invariants").select("id", "location.file_path", "entity", "invariant_type")
    return verify.compared(actual, _expected(s, d), "id", ["file_path", "entity", "invariant_type"])


@query(ACTUAL + " SELECT bool_and(passed) AS all_passed, count(*) FILTER (passed) AS passed, count(*) AS compared FROM r")
def pass_rate(s, d):
    """One row: whether all comparisons passed, and how many did."""
    return wildcard_compare(s, d).agg(F.bool_and("passed").alias("all_passed"), F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("compared"))


@query(f"""WITH v AS (SELECT id, min(invariant_type IS NOT NULL) AS valid, min(confidence) AS confidence FROM invariants_mirror GROUP BY 1),
f AS (SELECT id, {CONF} AS stated FROM invariants), a AS (SELECT id, valid, {CONF} AS adjusted FROM v)
SELECT f.id, CASE WHEN a.id IS NULL THEN stated ELSE adjusted END AS confidence FROM f LEFT JOIN a ON f.id = a.id WHERE coalesce(valid, true)""")
def validation_pass(s, d):
    """The mirror as validator: a row without a type is an invalid finding, its confidence the adjusted one."""
    v = table(s, d, "invariants_mirror").select("id", F.col("invariant_type").isNotNull().alias("valid"), F.col("confidence").alias("adjusted_confidence"))
    return verify.validated(table(s, d, "invariants"), v)


# --- regions and source

@query(f"""WITH p AS (SELECT location.file_path AS path, greatest(location.line_start - 5, 0) AS s, max(location.line_end) + 5 AS e, max(CASE {CONF} WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS weight FROM invariants WHERE location.file_path IS NOT NULL AND location.line_start IS NOT NULL AND location.line_end IS NOT NULL GROUP BY 1, 2),
f AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY path ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM p),
g AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY s) AS island FROM f)
SELECT path, greatest(min(s), 1) AS line_start, max(e) AS line_end, max(weight) AS weight FROM g GROUP BY path, island""")
def region_merge(s, d):
    f = table(s, d, "invariants").select(F.col("location.file_path").alias("path"), "location.line_start", "location.line_end", C.confidence_rank(C.confidence_of(F.col("confidence"))).alias("weight"))
    return regions.merged(f)


@query(f"""WITH c AS (SELECT file_path, {LINES} AS ls FROM chunks WHERE raw_source IS NOT NULL AND chunk_id = module_path),
r AS (SELECT i.id, c.file_path, list_slice(c.ls, i.location.line_start, i.location.line_end) AS x FROM invariants i JOIN c ON c.file_path = i.location.file_path WHERE i.location.line_start >= 1 AND i.location.line_end >= i.location.line_start)
SELECT id, file_path, len(x) AS region_lines, md5(array_to_string(x, chr(10))) AS region_md5 FROM r WHERE octet_length(encode(array_to_string(x, chr(10)))) >= 20""")
def region_slice(s, d):
    return regions.sliced(table(s, d, "invariants"), table(s, d, "chunks")).select("id", "file_path", "region_lines", F.md5("region").alias("region_md5"))


@query("SELECT id, location.file_path AS file_path FROM invariants WHERE location.file_path IN (SELECT file_path FROM chunks)")
def file_exists_semi(s, d):
    f = table(s, d, "invariants").select("id", "location.file_path")
    return f.join(table(s, d, "chunks").select("file_path").distinct(), "file_path", "left_semi").select("id", "file_path")


@query(r"""WITH p AS (SELECT crate_name, chunk_id, file_path, list_filter(string_split(regexp_replace(regexp_replace(file_path, '^.*/src/', ''), '\.rs$', ''), '/'), lambda y: y NOT IN ('', 'mod', 'lib', 'main')) AS k FROM chunks)
SELECT crate_name, chunk_id, CASE WHEN len(k) = 0 THEN 'crate' ELSE array_to_string(k, '::') END AS module, replace(replace(replace(replace(regexp_replace(file_path, '(\.rs)+$', ''), '/', '::'), '::mod', ''), '::lib', 'crate'), '::main', 'crate') AS semantic FROM p""")
def module_name(s, d):
    return table(s, d, "chunks").select("crate_name", "chunk_id", modules.module_of(F.col("file_path")).alias("module"), modules.semantic_module(F.col("file_path")).alias("semantic"))


@query(rf"""WITH {NUMBERED_LINES}, n AS (SELECT crate_name, chunk_id, regexp_extract(line, '^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+([^\s;{{]+)', 1) AS declared FROM l) SELECT * FROM n WHERE declared NOT IN ('', 'tests')""")
def mod_edges(s, d):
    return modules.declarations(table(s, d, "chunks"))


@query(f"WITH {TREE} SELECT * FROM c")
def child_resolution(s, d):
    """Submodules that a source declares, or a path implies, and that are there."""
    return modules.children(table(s, d, "chunks"), by_path=True)


@query(f"""WITH RECURSIVE {TREE}, e AS (SELECT CASE WHEN parent = 'crate' THEN crate_name ELSE crate_name || '::' || parent END AS parent, CASE WHEN module = 'crate' THEN crate_name ELSE crate_name || '::' || module END AS module FROM c UNION SELECT 'workspace', crate_name FROM m WHERE module = 'crate'),
b AS (SELECT 'workspace' AS module, 0 AS depth UNION SELECT e.module, b.depth + 1 FROM b JOIN e ON e.parent = b.module WHERE b.depth < 64)
SELECT module, min(depth) AS depth FROM b GROUP BY 1""")
def bfs_depth(s, d):
    """Every module that is reached from the workspace's root, with its depth."""
    return modules.reached(modules.workspace(table(s, d, "chunks"), by_path=True))


@query(f"WITH {ITEMS} SELECT * FROM items")
def items(s, d):
    return modules.items(table(s, d, "chunks"))


@query(f"WITH {CLUSTERS} SELECT * FROM clusters")
def type_clusters(s, d):
    """Each chunk's items by the type they speak of, with what an empty or a loose cluster does."""
    return modules.clusters(table(s, d, "chunks")).drop("lines")


@query(f"""WITH {CLUSTERS}, w AS (SELECT crate_name, chunk_id, cluster, list(summary) OVER (PARTITION BY crate_name, chunk_id ORDER BY cluster ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS every, CAST(row_number() OVER (PARTITION BY crate_name, chunk_id ORDER BY cluster) AS INTEGER) AS r FROM clusters)
SELECT crate_name, chunk_id, cluster, CASE WHEN len(every) > 1 THEN chunk_id || '#' || (r - 1) ELSE chunk_id END AS part, CASE WHEN len(every) > 1 THEN array_to_string(list_concat(list_slice(every, 1, r - 1), list_slice(every, r + 1, len(every))), '; ') END AS siblings FROM w""")
def cluster_siblings(s, d):
    """Each cluster's name within its module and what the other parts hold."""
    return modules.siblings(modules.clusters(table(s, d, "chunks")))


@query()
def cluster_sources(s, d):
    """The lines of each cluster, with marks where others were left out."""
    return modules.cluster_sources(table(s, d, "chunks")).select("crate_name", "chunk_id", "cluster", F.octet_length("source").alias("bytes"), F.md5("source").alias("source_md5"))


@query(rf"""WITH {NUMBERED_LINES}, h AS (SELECT crate_name, chunk_id, no, line, regexp_extract(line, '{HEAD}', ['v', 'k', 'n']) AS x FROM l WHERE regexp_matches(line, '{HEAD}'))
SELECT crate_name, chunk_id, CAST(no AS INTEGER) AS line_no, x.k AS kind, x.n AS name, CASE WHEN x.v = '' THEN 'private' WHEN regexp_matches(x.v, '^pub\s+$') THEN 'public' WHEN contains(x.v, '(crate)') THEN 'crate' ELSE 'restricted' END AS visibility,
  x.k = 'impl' AND regexp_replace(x.n, '^.*::', '') IN ('Debug', 'Clone', 'Copy', 'Default', 'Display', 'PartialEq', 'Eq', 'Hash', 'PartialOrd', 'Ord') AND regexp_matches(line, '\sfor\s') AS trivial FROM h""")
def item_headers(s, d):
    return modules.headers(table(s, d, "chunks"))


@query(rf"""WITH {NUMBERED_LINES}, s AS (SELECT *, length(regexp_replace(line, '[^{{]', '', 'g')) - length(regexp_replace(line, '[^}}]', '', 'g')) AS st FROM l),
p AS (SELECT crate_name, chunk_id, no, line, st, sum(st) OVER (PARTITION BY crate_name, chunk_id ORDER BY no) AS dp, max(no) OVER (PARTITION BY crate_name, chunk_id) AS last FROM s),
h AS (SELECT *, dp - st AS base FROM p WHERE regexp_matches(line, '{HEAD}'))
SELECT h.crate_name, h.chunk_id, CAST(h.no AS INTEGER) AS line_no, CAST(coalesce(min(p.no), any_value(h.last)) AS INTEGER) AS end_line FROM h LEFT JOIN p ON p.crate_name = h.crate_name AND p.chunk_id = h.chunk_id AND p.no > h.no AND p.dp <= h.base GROUP BY h.crate_name, h.chunk_id, h.no""")
def item_spans(s, d):
    return modules.spans(table(s, d, "chunks"))


@query("""SELECT crate_name, chunk_id, impl_block, list_filter(list_concat(coalesce(structs, []), coalesce(enums, [])), lambda y: contains(impl_block, y))[1] AS anchor
FROM (SELECT crate_name, chunk_id, structs, enums, unnest(impl_blocks) AS impl_block FROM chunks)""")
def first_claim(s, d):
    return modules.claims(table(s, d, "chunks"))


@query("""WITH p AS (SELECT crate_name, chunk_id, list_concat(list_transform(coalesce(structs, []), lambda y: 'struct ' || y), list_transform(coalesce(enums, []), lambda y: 'enum ' || y), list_transform(coalesce(traits, []), lambda y: 'trait ' || y),
  CASE WHEN len(coalesce(functions, [])) > 0 THEN [len(functions) || ' free function(s)'] ELSE [] END, list_transform(coalesce(impl_blocks, []), lambda y: 'impl ' || y)) AS parts FROM chunks)
SELECT crate_name, chunk_id, coalesce(array_to_string(parts, ', '), '') AS summary, len(parts) > 0 AS has_content FROM p""")
def cluster_summary(s, d):
    return modules.summary(table(s, d, "chunks"))


@query("""WITH a AS (SELECT crate_name, module_path, list(chunk_id ORDER BY chunk_id) AS every FROM chunks WHERE module_path IS NOT NULL GROUP BY 1, 2)
SELECT c.crate_name, c.chunk_id, CAST(list_position(a.every, c.chunk_id) - 1 AS INTEGER) AS ordinal, CAST(len(a.every) AS INTEGER) AS parts, coalesce(array_to_string(list_filter(a.every, lambda y: y <> c.chunk_id), '; '), '') AS siblings FROM chunks c JOIN a ON a.crate_name = c.crate_name AND a.module_path = c.module_path""")
def chunk_ordinals(s, d):
    return modules.ordinals(table(s, d, "chunks"))


@query(rf"""WITH {ITEMS}, f AS (SELECT crate_name, chunk_id, 50 * count(*) FILTER (kind = 'struct' AND phantom) + 40 * count(*) FILTER (kind = 'impl' AND trait = 'Drop') + 30 * count(*) FILTER (kind = 'impl' AND owned) + 20 * count(*) FILTER (kind = 'impl' AND unsafe) + CASE WHEN count(*) FILTER (kind = 'fn' AND unsafe) > 0 THEN 20 ELSE 0 END AS found FROM items GROUP BY 1, 2)
SELECT c.crate_name, c.chunk_id, CAST(CASE WHEN {HIT} THEN 1000 ELSE 0 END + CASE WHEN regexp_matches(lower(coalesce(raw_source, '')), 'safety|must|invariant|precondition') THEN 10 ELSE 0 END + coalesce(found, 0) AS BIGINT) AS score FROM chunks c LEFT JOIN f ON f.crate_name = c.crate_name AND f.chunk_id = c.chunk_id""")
def priority_order(s, d):
    """Chunks with their score, the most telling first."""
    return modules.scores(table(s, d, "chunks"), PREFIXES).orderBy(F.col("score").desc(), "crate_name", "chunk_id")


@query(f"WITH {ITEMS}, f AS (SELECT crate_name, chunk_id, sum(chars) AS chars FROM items GROUP BY 1, 2) SELECT c.crate_name, c.chunk_id, CAST(coalesce(chars, 0) // 4 AS BIGINT) AS tokens FROM chunks c LEFT JOIN f ON f.crate_name = c.crate_name AND f.chunk_id = c.chunk_id")
def chunk_tokens(s, d):
    return modules.tokens_of(table(s, d, "chunks"))


TEMPLATE = "Module: {module}\nFile: {file}\n\n```rust\n{source}\n```\n"


@query()
def prompt_text(s, d):
    """Each chunk's prompt: the template with the module, the file, a note of the siblings and the source, cut at 50,000 bytes."""
    t = table(s, d, "chunks")
    head = F.when(F.col("sibling_summary").isNotNull(), F.concat(F.lit("// Note: "), "sibling_summary", F.lit("\n"))).otherwise("")
    source = C.cut_bytes(F.concat(head, F.coalesce("raw_source", F.lit(""))), 50_000, "\n// ... (truncated) ...")
    return t.select("crate_name", "chunk_id", R.prompt(TEMPLATE, module=F.col("module_path"), file=F.col("file_path"), source=source).alias("prompt"))


@query()
def detect_signals(s, d):
    """The offline detector over every chunk."""
    return detect.signals(table(s, d, "chunks"))


# --- replies

@query(r"SELECT file_id, CASE WHEN strpos(payload, '[') > 0 AND strpos(payload, ']') > 0 AND length(payload) - strpos(reverse(payload), ']') + 1 > strpos(payload, '[') THEN md5(substr(payload, strpos(payload, '['), length(payload) - strpos(reverse(payload), ']') + 1 - strpos(payload, '[') + 1)) END AS array_md5, CASE WHEN strpos(payload, '{') > 0 AND strpos(payload, '}') > 0 AND length(payload) - strpos(reverse(payload), '}') + 1 > strpos(payload, '{') THEN md5(substr(payload, strpos(payload, '{'), length(payload) - strpos(reverse(payload), '}') + 1 - strpos(payload, '{') + 1)) END AS object_md5 FROM report_files")
def json_extract(s, d):
    """The JSON array and object within each payload, as a reply that holds them in a fence."""
    reply = F.concat(F.lit("Here is the result:\n```json\n"), F.col("payload"), F.lit("\n```\nDone."))
    return table(s, d, "report_files").select("file_id", F.md5(R.json_part(reply)).alias("array_md5"), F.md5(R.json_part(reply, "{", "}")).alias("object_md5"))


@query("""WITH a AS (SELECT file_id, CASE WHEN json_valid(payload) AND json_type(payload, '$.invariants') = 'ARRAY' THEN json_extract(payload, '$.invariants[*]') END AS l FROM report_files)
SELECT file_id, CASE WHEN len(list_filter(l, lambda x: coalesce(json_type(x, '$.id') IN ('UBIGINT', 'BIGINT') AND json_type(x, '$.title') = 'VARCHAR' AND json_type(x, '$.invariant_type') = 'VARCHAR' AND json_type(x, '$.confidence') = 'VARCHAR' AND coalesce(json_type(x, '$.severity'), 'VARCHAR') = 'VARCHAR', false))) = len(l) THEN CAST(len(l) AS INTEGER) END AS entries FROM a""")
def reply_decode(s, d):
    """All or nothing: the entries of a report's array, if each of them has the fields of the layout with their types; null if not."""
    reply = F.get_json_object("payload", "$.invariants")
    return table(s, d, "report_files").select("file_id", R.decoded(reply, {"id": "whole", "title": "text", "invariant_type": "text", "confidence": "text"}, {"severity": "text"}).alias("entries"))


@query(r"""WITH o AS (SELECT file_id, CASE WHEN strpos(payload, '{') > 0 AND strpos(payload, '}') > 0 AND length(payload) - strpos(reverse(payload), '}') + 1 > strpos(payload, '{') THEN substr(payload, strpos(payload, '{'), length(payload) - strpos(reverse(payload), '}') + 1 - strpos(payload, '{') + 1) ELSE payload END AS b FROM report_files)
SELECT file_id, NOT coalesce(json_valid(b), false) AS valid, 'medium' AS adjusted_confidence FROM o""")
def verdict_decode(s, d):
    """Payloads read as a validator's replies: what is no JSON counts as valid, what does not say so as invalid."""
    return table(s, d, "report_files").select("file_id", R.verdict(F.col("payload")).alias("v")).select("file_id", "v.valid", "v.adjusted_confidence")


@query()
def explanation_build(s, d):
    """Each explanation taken apart and built again from its labelled fields."""
    part = {x: R.field(F.col("evidence.explanation"), x) for x in R.LABELS}
    listed = lambda c, at: F.filter(F.split(F.coalesce(c, F.lit("")), at), lambda x: x != "")
    built = R.explanation(part["Entity"], listed(part["States"], ", "), F.lit(None).cast("string"), listed(part["Transitions"], r"\n?- "), listed(part["Evidence"], "; "), part["Implementation"])
    return table(s, d, "invariants").select("id", built.alias("explanation"))


@query()
def reply_fields(s, d):
    """The labelled fields of each explanation."""
    return table(s, d, "invariants").select("id", *[R.field(F.col("evidence.explanation"), x).alias(x.lower()) for x in R.LABELS])


@query("SELECT id, location.file_path AS path, CAST(0.5 AS DOUBLE) AS similarity, CAST(location.line_start AS INTEGER) AS line_start, CAST(location.line_end AS INTEGER) AS line_end FROM invariants WHERE regexp_matches(location.file_path, '^\\S+\\.rs$') AND location.line_start IS NOT NULL AND location.line_end IS NOT NULL")
def search_text_parse(s, d):
    """Findings' places, written as a search listing and read again."""
    loc = F.col("location")
    text = F.concat(F.lit("1. "), loc["file_path"], F.lit("\n   Similarity 0.5\n"), loc["line_start"].cast("string"), F.lit(": let a = 1;\n"), loc["line_end"].cast("string"), F.lit(": let b = 2;"))
    hit = table(s, d, "invariants").select("id", F.explode(R.hits(text)).alias("h"))
    return hit.select("id", "h.path", "h.similarity", "h.line_start", "h.line_end")


# --- progress, tokens, budget

@query(r"WITH p AS (SELECT *, lower(regexp_replace(status, '^\s+|\s+$', '', 'g')) AS s FROM progress) SELECT run_id, count(*) FILTER (s = 'completed') AS completed, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s = 'skipped') AS skipped, CAST(coalesce(sum(invariants_found), 0) AS BIGINT) AS invariants_found, CAST(coalesce(sum(tokens_used), 0) AS BIGINT) AS tokens_used FROM p GROUP BY 1")
def progress_counters(s, d):
    return summaries.progress_counters(table(s, d, "progress"))


@query(f"SELECT crate_name, chunk_id FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM ({DONE}) x WHERE x.crate_name = c.crate_name AND x.chunk_id = c.chunk_id)")
def resume_anti(s, d):
    return schedule.pending(table(s, d, "chunks"), table(s, d, "progress")).select("crate_name", "chunk_id")


@query(f"WITH x AS ({DONE}), j AS (SELECT {HIT} AS hit, x.chunk_id IS NOT NULL AS done FROM chunks c LEFT JOIN x ON x.crate_name = c.crate_name AND x.chunk_id = c.chunk_id) SELECT count(*) FILTER (hit AND done) AS priority_done, count(*) FILTER (hit) AS priority_total, count(*) FILTER (NOT hit AND done) AS other_done, count(*) FILTER (NOT hit) AS other_total FROM j")
def coverage(s, d):
    return summaries.coverage(table(s, d, "chunks"), schedule.completed(table(s, d, "progress")), PREFIXES)


@query(f"SELECT delivery_no, run_id, CAST(coalesce(sum(coalesce(tokens_used, 0)) OVER w, 0) AS BIGINT) AS before, {HIT} OR coalesce(sum(coalesce(tokens_used, 0)) OVER w, 0) < {BUDGET} AS taken FROM progress WINDOW w AS (PARTITION BY run_id ORDER BY delivery_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def budget_cutoff(s, d):
    p = table(s, d, "progress").select("delivery_no", "run_id", "module_path", "tokens_used")
    hit = F.exists(F.array(*map(F.lit, PREFIXES)), lambda x: F.coalesce(F.col("module_path"), F.lit("")).contains(x))
    return schedule.within_budget(p, ["run_id"], "delivery_no", "tokens_used", BUDGET, hit).select("delivery_no", "run_id", "before", "taken")


@query("SELECT delivery_no, run_id, row_number() OVER (PARTITION BY run_id ORDER BY received_at NULLS FIRST, delivery_no) AS place FROM progress")
def arrival_order(s, d):
    """Each row's place in its run by time of arrival."""
    p = table(s, d, "progress").select("delivery_no", "run_id", "received_at")
    return order.numbered(p, ["run_id"], "received_at", "delivery_no").select("delivery_no", "run_id", F.col("seq").alias("place"))


@query("SELECT delivery_no, row_number() OVER (ORDER BY received_at NULLS FIRST, delivery_no) AS place FROM progress")
def global_order(s, d):
    """Each row's place among all rows by time of arrival, found without one task that holds them."""
    p = table(s, d, "progress").select("delivery_no", "received_at")
    return order.numbered(p, [], "received_at", "delivery_no", span=4096).select("delivery_no", F.col("seq").alias("place"))


@query(r"""SELECT delivery_no, regexp_matches(lower(error), '429|rate limit|rate_limit|too many requests|500|502|503|529|overloaded|capacity|timeout|timed out|connection reset|connection refused|connection closed|broken pipe|eof|dns error|network|temporarily unavailable|server error') AS retryable,
  CAST(nullif(coalesce(nullif(regexp_extract(lower(error), 'retry after (\d+)', 1), ''), nullif(regexp_extract(lower(error), 'retry-after: (\d+)', 1), ''), regexp_extract(lower(error), 'try again in (\d+)', 1)), '') AS BIGINT) AS asked FROM progress WHERE error IS NOT NULL""")
def retryable(s, d):
    """Errors worth another try, with the seconds that they ask for."""
    p = table(s, d, "progress").where("error IS NOT NULL")
    return p.select("delivery_no", C.is_retryable(F.col("error")).alias("retryable"), C.retry_after(F.col("error")).alias("asked"))


@query("""WITH t AS (SELECT delivery_no, CAST(delivery_no % 8 AS BIGINT) AS a, CAST(tokens_used % 7 AS BIGINT) AS c, invariants_found AS asked FROM progress WHERE tokens_used IS NOT NULL),
x AS (SELECT *, CAST(1000 * pow(2, a) AS BIGINT) * (least(c, 5) + 1) AS d FROM t)
SELECT delivery_no, CAST(CASE WHEN asked IS NOT NULL AND asked > 2 THEN (asked + 1) * 1000 ELSE least(d - d // 4 + (a * 7 + c * 13) % (2 * (d // 4)), 300000) END AS BIGINT) AS delay_ms FROM x""")
def backoff_delay(s, d):
    """The pause after each row, as if its numbers were a try's."""
    p = table(s, d, "progress").where("tokens_used IS NOT NULL")
    asked = F.when(F.col("invariants_found") > 2, F.col("invariants_found"))
    return p.select("delivery_no", C.backoff_ms(F.col("delivery_no") % 8, F.col("tokens_used") % 7, asked).alias("delay_ms"))


@query("""WITH s AS (SELECT 'detector' AS role, detector AS t FROM token_usage UNION ALL SELECT 'validator', validator FROM token_usage),
g AS (SELECT coalesce(role, 'grand') AS role, t FROM s UNION ALL SELECT 'grand', t FROM s)
SELECT role, CAST(coalesce(sum(t.input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(t.cached_tokens), 0) AS BIGINT) AS cached_tokens, CAST(coalesce(sum(t.output_tokens), 0) AS BIGINT) AS output_tokens, CAST(coalesce(sum(t.reasoning_tokens), 0) AS BIGINT) AS reasoning_tokens, CAST(coalesce(sum(t.total_tokens), 0) AS BIGINT) AS total_tokens, count(t) AS runs FROM g GROUP BY 1""")
def token_rollup(s, d):
    return summaries.token_totals(table(s, d, "token_usage"))


@query("SELECT run_id, CASE WHEN grand_total_tokens >= 1000000 THEN printf('%.1fM', grand_total_tokens / 1e6) WHEN grand_total_tokens >= 1000 THEN printf('%.0fK', grand_total_tokens / 1e3) ELSE CAST(grand_total_tokens AS VARCHAR) END AS tokens FROM token_usage")
def token_format(s, d):
    return table(s, d, "token_usage").select("run_id", C.short_count(F.col("grand_total_tokens")).alias("tokens"))


# --- reports

PROGRAM = "regexp_extract(location.file_path, '^/data/([^/]+)/', 1)"


@query(f"""WITH f AS (SELECT {PROGRAM} AS program, {KIND} AS kind FROM invariants), a AS (SELECT program, count(*) AS findings, {COUNTS} FROM f GROUP BY 1)
SELECT p.program, {", ".join(f"coalesce(a.{k}, 0) AS {k}" for k in ("findings", *C.KINDS))} FROM (SELECT DISTINCT crate_name AS program FROM chunks) p LEFT JOIN a ON a.program = p.program""")
def consolidate(s, d):
    f = table(s, d, "invariants").select("invariant_type", F.regexp_extract("location.file_path", "^/data/([^/]+)/", 1).alias("program"))
    return summaries.consolidated(f, table(s, d, "chunks").select(F.col("crate_name").alias("program")))


@query("SELECT DISTINCT crate_name AS program FROM chunks WHERE crate_name NOT IN (SELECT crate_name FROM report_files WHERE crate_name IS NOT NULL)")
def programs_without_report(s, d):
    c = table(s, d, "chunks").select(F.col("crate_name").alias("program")).where("program IS NOT NULL").distinct()
    return c.join(table(s, d, "report_files").select(F.col("crate_name").alias("program")), "program", "left_anti")


@query("SELECT file_id, 'report' || lpad(CAST(row_number() OVER (PARTITION BY crate_name ORDER BY written_at NULLS FIRST, file_id) AS VARCHAR), 3, '0') || '.json' AS file_name FROM report_files")
def report_names(s, d):
    """Each report's name by its place in its crate, of three digits or more; the SQL's lpad cuts places over 999."""
    r = table(s, d, "report_files").select("file_id", "crate_name", "written_at")
    return order.numbered(r, ["crate_name"], "written_at", "file_id").select("file_id", F.format_string("report%03d.json", "seq").alias("file_name"))


FAILED = "x AS (SELECT run_id, 'report' || file_id AS file, 'no valid JSON' AS error FROM report_files WHERE NOT coalesce(json_valid(payload), false))"
SUMMED = f"""{FAILED}, v AS (SELECT *, {KIND} AS kind, {CONF} AS conf FROM invariants),
f AS (SELECT run_id, count(*) AS total_invariants, {", ".join(f"count(*) FILTER (kind = '{k}') AS {k}_count" for k in C.KINDS)}, count(DISTINCT location.file_path) AS modules_analyzed, max(id) AS last_id FROM v GROUP BY 1),
z AS (SELECT run_id, count(*) AS failures, max(file) AS last_file FROM x GROUP BY 1),
s AS (SELECT run_id, {", ".join(f"coalesce({c}, 0) AS {c}" for c in sinks.COUNTS)}, coalesce(failures, 0) AS failures, last_id, last_file FROM f FULL JOIN z USING (run_id))"""
BLOCK = """'### ' || id || '. ' || coalesce(title, '') || chr(10) || chr(10) || '**Location**: `' || coalesce(location.file_path, '') || ':' || coalesce(CAST(location.line_start AS VARCHAR), '') || '-' || coalesce(CAST(location.line_end AS VARCHAR), '') || '`' || chr(10) || chr(10)
  || '**Confidence**: ' || upper(conf[1]) || conf[2:] || chr(10) || chr(10) || '**Suggested Pattern**: ' || coalesce(suggested_pattern, '') || chr(10) || chr(10) || '**Description**: ' || coalesce(description, '') || chr(10) || chr(10)
  || '**Evidence**:' || chr(10) || chr(10) || '```rust' || chr(10) || coalesce(evidence.code_snippet, '') || chr(10) || '```' || chr(10) || chr(10) || CASE WHEN coalesce(evidence.explanation, '') <> '' THEN evidence.explanation || chr(10) || chr(10) ELSE '' END || '---' || chr(10) || chr(10)"""
SECTION = "list_position(['temporal_ordering', 'resource_lifecycle', 'state_machine', 'precondition', 'protocol'], kind)"
TITLES = "['Temporal Ordering', 'Resource Lifecycle', 'State Machine', 'Precondition', 'Protocol']"


def _failures(s, d):
    r = table(s, d, "report_files").where(F.try_parse_json("payload").isNull())
    return r.select("run_id", F.concat(F.lit("report"), "file_id").alias("file"), F.lit("no valid JSON").alias("error"))


@query(f"""WITH {SUMMED} SELECT run_id, 0 AS section, '' AS place, '# Latent Invariant Analysis Report' || chr(10) || chr(10) || '## Summary' || chr(10) || chr(10) || '- **Total invariants discovered**: ' || total_invariants || chr(10) || '- **Temporal ordering**: ' || temporal_ordering_count || chr(10) || '- **Resource lifecycle**: ' || resource_lifecycle_count || chr(10)
  || '- **State machine**: ' || state_machine_count || chr(10) || '- **Precondition**: ' || precondition_count || chr(10) || '- **Protocol**: ' || protocol_count || chr(10) || '- **Modules analyzed**: ' || modules_analyzed || chr(10) || chr(10) AS block FROM s
UNION ALL SELECT DISTINCT run_id, {SECTION}, '', '## ' || {TITLES}[{SECTION}] || ' Invariants' || chr(10) || chr(10) FROM v
UNION ALL SELECT run_id, {SECTION}, lpad(CAST(id AS VARCHAR), 20, '0'), {BLOCK} FROM v
UNION ALL SELECT run_id, 6, '', '## Skipped Files' || chr(10) || chr(10) || failures || ' file(s) could not be parsed:' || chr(10) || chr(10) FROM s WHERE failures > 0
UNION ALL SELECT run_id, 6, file, '- `' || file || '`: ' || error || chr(10) FROM x""")
def report_markdown(s, d):
    """Every run's report, block by block in order."""
    return sinks.report_markdown(table(s, d, "invariants"), _failures(s, d), "run_id")


@query(f"""WITH {SUMMED}, j AS (SELECT v.run_id, id, last_id, to_json(struct_pack(id := id, invariant_type := kind, title := title, description := description, location := location, evidence := evidence, suggested_pattern := suggested_pattern, confidence := conf, entity := entity)) AS e FROM v JOIN s ON s.run_id IS NOT DISTINCT FROM v.run_id)
SELECT run_id, 0 AS section, '' AS place, '{{"summary": ' || CAST(to_json(struct_pack({", ".join(f"{c} := {c}" for c in sinks.COUNTS)})) AS VARCHAR) || ', "invariants": [' AS line FROM s
UNION ALL SELECT run_id, 1, lpad(CAST(id AS VARCHAR), 20, '0'), CAST(e AS VARCHAR) || CASE WHEN id < last_id THEN ',' ELSE '' END FROM j
UNION ALL SELECT run_id, 2, '', '], "parse_failures": [' FROM s
UNION ALL SELECT x.run_id, 3, file, CAST(to_json([file, error]) AS VARCHAR) || CASE WHEN file < last_file THEN ',' ELSE '' END FROM x JOIN s ON s.run_id IS NOT DISTINCT FROM x.run_id
UNION ALL SELECT run_id, 4, '', ']}}' FROM s""")
def report_entries(s, d):
    """Every run's JSON report, line by line in order."""
    return sinks.report_json(table(s, d, "invariants"), _failures(s, d), "run_id")


@query("""WITH u AS (SELECT run_id, struct_pack(input_tokens := coalesce(detector.input_tokens, 0), cached_tokens := coalesce(detector.cached_tokens, 0), output_tokens := coalesce(detector.output_tokens, 0), reasoning_tokens := coalesce(detector.reasoning_tokens, 0), total_tokens := coalesce(detector.total_tokens, 0)) AS d,
  struct_pack(input_tokens := coalesce(validator.input_tokens, 0), cached_tokens := coalesce(validator.cached_tokens, 0), output_tokens := coalesce(validator.output_tokens, 0), reasoning_tokens := coalesce(validator.reasoning_tokens, 0), total_tokens := coalesce(validator.total_tokens, 0)) AS v FROM token_usage)
SELECT run_id, CAST(to_json(struct_pack(detector := d, validator := v, grand_total_tokens := d.total_tokens + v.total_tokens)) AS VARCHAR) AS usage FROM u WHERE d.total_tokens + v.total_tokens > 0""")
def token_usage_json(s, d):
    return sinks.usage_json(table(s, d, "token_usage"))


@query("""WITH l AS (SELECT crate_name AS program, payload FROM report_files WHERE crate_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY crate_name ORDER BY written_at DESC NULLS LAST, file_id DESC) = 1),
r AS (SELECT program, coalesce(json_valid(payload), false) AS ok, CASE WHEN coalesce(json_valid(payload), false) THEN coalesce(json_array_length(payload, '$.invariants'), 0) ELSE 0 END AS n FROM l),
t AS (SELECT count(*) AS a, count(*) FILTER (ok AND n > 0) AS b, count(*) FILTER (ok AND n = 0) AS c, count(*) FILTER (NOT ok) AS d, CAST(coalesce(sum(n), 0) AS BIGINT) AS e FROM r)
SELECT 0 AS section, '0' AS place, '| Total programs analyzed | ' || a || ' |' AS line FROM t UNION ALL SELECT 0, '1', '| Programs with invariants | ' || b || ' |' FROM t UNION ALL SELECT 0, '2', '| Programs without invariants | ' || c || ' |' FROM t
UNION ALL SELECT 0, '3', '| Programs that failed | ' || d || ' |' FROM t UNION ALL SELECT 0, '4', '| **Total invariants found** | ' || e || ' |' FROM t
UNION ALL SELECT CASE WHEN NOT ok THEN 3 WHEN n > 0 THEN 1 ELSE 2 END, program, '- ' || CASE WHEN NOT ok THEN program || ' (error: no valid JSON)' WHEN n > 0 THEN '[' || program || '](#' || lower(regexp_replace(program, '[_ ]', '-', 'g')) || ') (' || n || ' invariants)' ELSE program END FROM r""")
def consolidated_markdown(s, d):
    """One document over all programs, each by its latest report."""
    r = table(s, d, "report_files").select(F.col("crate_name").alias("program"), "written_at", "file_id", "payload")
    return sinks.consolidated_markdown(r)


@query(r"""WITH n AS (SELECT DISTINCT run_id FROM progress), x AS (SELECT run_id, regexp_extract(run_id, '^(.*)_(\d{8}_\d{6})_(bfs|ss)$', ['m', 't', 'o']) AS p FROM n)
SELECT run_id, 'runs/' || p.m || '_' || p.t || '_' || p.o AS directory FROM x WHERE p.m <> ''""")
def run_directories(s, d):
    """Where each run of the log would write."""
    rx = r"^(.*)_(\d{8}_\d{6})_(bfs|ss)$"
    part = lambda i: F.regexp_extract("run_id", rx, i)
    r = table(s, d, "progress").select("run_id").distinct().where(F.col("run_id").rlike(rx))
    return r.select("run_id", sinks.run_directory(part(1), F.to_timestamp(part(2), "yyyyMMdd_HHmmss"), part(3)).alias("directory"))


# --- search

@query("""WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS similarity FROM q JOIN embeddings v ON v.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS INTEGER) AS place FROM s WHERE similarity >= 0.1) SELECT * FROM r WHERE place <= 20""")
def topk_per_query(s, d):
    """The 20 nearest vectors of every vector whose id is divisible by 50, among all vectors."""
    v = table(s, d, "embeddings")
    return search.nearest(v, v.where("vec_id % 50 = 0"))


