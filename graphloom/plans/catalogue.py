"""The query catalogue: one entry for each operator, with its SQL equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import parse
from graphloom.functions import text as tx
from graphloom.operators import analytics, backends, chunks, cluster, dedupe, evaluate, extract, graph, lexical, retrieve, sentences
from graphloom.plans import fixtures as fx
from graphloom.plans import lifecycles
from graphloom.schema import KGFrames
from graphloom.sources import json_records, property_graph, sinks
from graphloom.sources.json_arrays import write_array
from graphloom.storage import shared_path
from graphloom.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _act(spark, d) -> KGFrames:
    return graph.build(fx.activity(spark, d))


ENDS = "SELECT s AS name FROM {0} UNION ALL SELECT o FROM {0}"
DEG = f"deg AS (SELECT name, count(*) AS degree, sum(1 - o)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT s AS name, 1 AS o FROM {{0}} UNION ALL SELECT o, 0 FROM {{0}}) GROUP BY name)"


# --- building ---------------------------------------------------------------------------------


@_query(f"WITH {fx.KG} SELECT 'kg' AS graph_id, s, p, o FROM kg")
def graph_build_triples(spark, d):
    return graph.build(fx.kg(spark, d)).triples


@_query(f"WITH {fx.KG} SELECT DISTINCT 'kg' AS graph_id, name FROM ({ENDS.format('kg')})")
def graph_entities(spark, d):
    return graph.build(fx.kg(spark, d)).entities


@_query(f"WITH {fx.KG} SELECT DISTINCT 'kg' AS graph_id, p AS name FROM kg")
def graph_predicates(spark, d):
    return graph.build(fx.kg(spark, d)).predicates


@_query(f"WITH {fx.KG}, e AS (SELECT s_name AS name FROM supplier) SELECT DISTINCT 'kg' AS graph_id, name, name NOT IN (SELECT name FROM e) AS added FROM (SELECT name FROM e UNION ALL {ENDS.format('kg')})")
def graph_repair_endpoints(spark, d):
    known = fx.table(spark, d, "supplier").select(F.lit("kg").alias("graph_id"), F.col("s_name").alias("name"))
    cut = graph.build(fx.kg(spark, d), known)
    added = graph.missing_endpoints(cut).withColumn("_a", F.lit(True))
    return graph.repair(cut).entities.join(added, ["graph_id", "name"], "left").select("graph_id", "name", F.coalesce("_a", F.lit(False)).alias("added"))


@_query(f"WITH {fx.KG}, {fx.ACTIVITY} SELECT 'all' AS graph_id, s, p, o FROM (SELECT * FROM kg UNION SELECT * FROM act)")
def graph_aggregate_union(spark, d):
    return graph.aggregate(graph.build(fx.kg(spark, d)), _act(spark, d)).triples


@_query(f"WITH {fx.KG} SELECT 'kg' AS graph_id, (SELECT count(DISTINCT name) FROM ({ENDS.format('kg')})) AS entities, count(DISTINCT p) AS predicates, count(*) AS relations FROM kg")
def graph_counts(spark, d):
    return graph.counts(graph.build(fx.kg(spark, d)))


@_query(f"""WITH {fx.KG}, n AS (SELECT count(DISTINCT name) AS n FROM (SELECT name FROM ({ENDS.format('kg')}) UNION ALL SELECT 'Event#' || event_type FROM events)),
i AS (SELECT count(DISTINCT event_type) AS i FROM events)
SELECT 'kg' AS graph_id, n AS entities, count(*) AS relations, count(DISTINCT p) AS predicates, i AS isolated, round(2.0 * count(*) / n, 2)::DOUBLE AS average_degree, round(count(*)::DOUBLE / (n * (n - 1)), 3) AS density FROM kg, n, i GROUP BY n, i""")
def graph_stats_counts(spark, d):
    g = graph.build(fx.kg(spark, d))
    lone = fx.table(spark, d, "events").select(F.lit("kg").alias("graph_id"), F.concat(F.lit("Event#"), "event_type").alias("name"))
    return analytics.statistics(KGFrames(g.entities.unionByName(lone).distinct(), g.predicates, g.triples))


@_query(f"WITH {fx.ACTIVITY} SELECT 'activity' AS graph_id, s AS src, o AS dst, max(p) AS rel FROM act GROUP BY s, o")
def digraph_collapse(spark, d):
    return graph.digraph(fx.activity(spark, d))


_POSITIONED = "pos AS (SELECT (user_id % 10)::VARCHAR AS graph_id, event_id AS pos, 'User#' || user_id AS s, event_type AS p, 'Item#' || json_extract_string(props, '$.k') AS o FROM events)"


def _positioned(spark, d):
    return fx.activity_rows(spark, d).select((F.col("user_id") % 10).cast("string").alias("graph_id"), F.col("event_id").alias("pos"), "s", "p", "o")


@_query(f"WITH {_POSITIONED}, f AS (SELECT graph_id, s, p, o, min(pos) AS pos FROM pos GROUP BY ALL) SELECT graph_id, s, p, o, (row_number() OVER (PARTITION BY graph_id ORDER BY pos, s, p, o) - 1)::INT AS rank FROM f")
def triples_convert_order(spark, d):
    return graph.convert(_positioned(spark, d))


@_query(f"""WITH {_POSITIONED} SELECT graph_id, (SELECT array_to_string(list_sort(list(DISTINCT name)), '|') FROM (SELECT s AS name FROM pos b WHERE b.graph_id = a.graph_id UNION SELECT o FROM pos b WHERE b.graph_id = a.graph_id)) AS entities,
array_to_string(list_sort(list(DISTINCT p)), '|') AS edges, count(DISTINCT (s, p, o)) AS n_relations FROM pos a GROUP BY graph_id""")
def triples_convert_sorted(spark, d):
    whole = graph.nested(graph.convert(_positioned(spark, d)))
    return whole.select("graph_id", F.array_join("entities", "|").alias("entities"), F.array_join("edges", "|").alias("edges"), F.size("relations").cast("long").alias("n_relations"))


@_query(f"WITH {fx.KG}, e AS (SELECT 'Part#' || p_partkey AS name FROM part WHERE p_size > 10 UNION SELECT s_name FROM supplier) SELECT 'kg' AS graph_id, s, p, o FROM kg WHERE s IN (SELECT name FROM e) AND o IN (SELECT name FROM e)")
def fallback_endpoint_filter(spark, d):
    parts = fx.table(spark, d, "part").where("p_size > 10").select(F.concat(F.lit("Part#"), F.col("p_partkey").cast("string")).alias("name"))
    names = parts.unionByName(fx.table(spark, d, "supplier").select(F.col("s_name").alias("name"))).withColumn("graph_id", F.lit("kg"))
    return graph.endpoint_filter(fx.kg(spark, d), names)


@_query(f"WITH {fx.ACTIVITY}, old AS (SELECT DISTINCT s, o FROM act WHERE p < 'd') SELECT 'activity' AS graph_id, s, p, o FROM act WHERE (s, o) NOT IN (SELECT (s, o) FROM old)")
def existing_pair_novelty(spark, d):
    act = fx.activity(spark, d)
    return graph.novel_pairs(act, act.where("p < 'd'"))


# --- analytics --------------------------------------------------------------------------------


@_query(f"WITH {fx.ACTIVITY}, {DEG.format('act')} SELECT 'activity' AS graph_id, * FROM deg")
def degree_counts(spark, d):
    return analytics.degrees(fx.activity(spark, d))


@_query(f"WITH {fx.KG}, {DEG.format('kg')} SELECT 'kg' AS graph_id, name, degree, row_number() OVER (ORDER BY degree DESC, lower(name), name)::INT AS rank FROM deg QUALIFY rank <= 10")
def top_entities(spark, d):
    return analytics.top_entities(graph.build(fx.kg(spark, d)))


@_query(f"WITH {fx.KG} SELECT 'kg' AS graph_id, p AS name, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, lower(p), p)::INT AS rank FROM kg GROUP BY p QUALIFY rank <= 10")
def top_relations(spark, d):
    return analytics.top_relations(graph.build(fx.kg(spark, d)))


@_query(f"WITH {fx.KG} SELECT 'kg' AS graph_id, 'Part#' || p_partkey AS name FROM part WHERE 'Part#' || p_partkey NOT IN (SELECT o FROM kg WHERE p = 'supplies' AND s < 'Supplier#000000005')")
def isolated_entities(spark, d):
    parts = fx.table(spark, d, "part").select(F.lit("kg").alias("graph_id"), F.concat(F.lit("Part#"), F.col("p_partkey").cast("string")).alias("name"))
    return analytics.isolated(graph.build(fx.kg(spark, d).where("p = 'supplies' and s < 'Supplier#000000005'"), parts))


_EDGES = "edges AS (SELECT *, row_number() OVER (ORDER BY lower(p), lower(s), lower(o), p, s, o) - 1 AS n FROM act)"


@_query(f"WITH {fx.ACTIVITY}, {_EDGES} SELECT 'activity' AS graph_id, s, p, o, 'e' || n AS id FROM edges")
def edge_ids(spark, d):
    return analytics.edge_ids(fx.activity(spark, d))


def _color_sql(x: str) -> str:
    """The colour formula over sha1(x), as a scalar expression."""
    byte = lambda i: f"('0x' || sha1({x})[{i}:{i + 1}])::INT::DOUBLE / 255.0"
    hue, full, light = byte(1), f"(0.55 + {byte(3)} * 0.3)::DOUBLE", f"(0.45 + {byte(5)} * 0.25)::DOUBLE"
    high = f"(CASE WHEN {light} <= 0.5 THEN {light} * ({full} + 1.0) ELSE {light} + {full} - {light} * {full} END)"
    low = f"({light} * 2.0 - {high})"

    def channel(shift: str) -> str:
        h = f"(({hue} + {shift}) - floor({hue} + {shift}))"
        value = f"CASE WHEN {h} < 1::DOUBLE / 6 THEN {low} + ({high} - {low}) * {h} * 6.0 WHEN {h} < 0.5 THEN {high} WHEN {h} < 2::DOUBLE / 3 THEN {low} + ({high} - {low}) * (2::DOUBLE / 3 - {h}) * 6.0 ELSE {low} END"
        return f"lpad(lower(to_hex(floor(({value}) * 255.0)::BIGINT)), 2, '0')"

    return f"'#' || {channel('1::DOUBLE / 3')} || {channel('0.0::DOUBLE')} || {channel('(-1::DOUBLE / 3)')}"


@_query(f"SELECT n_name, {_color_sql('n_name')} AS color FROM nation")
def color_hash(spark, d):
    return tx.with_color(fx.table(spark, d, "nation").select("n_name"), F.col("n_name"))


@_query(f"""WITH {fx.ACTIVITY}, {_EDGES}, k AS (SELECT DISTINCT p, {_color_sql("'predicate::' || p")} AS color FROM (SELECT DISTINCT p FROM act))
SELECT 'activity' AS graph_id, 'e' || n AS id, s AS source, o AS target, p AS predicate, NULL::VARCHAR AS cluster, color, s || ' —' || p || '→ ' || o AS tooltip FROM edges JOIN k USING (p)""")
def edge_view(spark, d):
    return analytics.edge_view(_act(spark, d))


@_query(f"""WITH {fx.ACTIVITY}, {_EDGES}, k AS (SELECT p, {_color_sql("'predicate::' || p")} AS color FROM (SELECT DISTINCT p FROM act))
SELECT 'activity' AS graph_id, s AS source, p AS predicate, o AS target, 'e' || n AS edge_id, color FROM edges JOIN k USING (p)""")
def relation_records(spark, d):
    return analytics.relation_records(_act(spark, d))


_CLUSTERS = "cl AS (SELECT DISTINCT 'Group#' || (user_id % 7) AS rep, 'User#' || user_id AS member FROM events WHERE user_id % 2 = 0)"


def _clusters(spark, d):
    rows = fx.table(spark, d, "events").where("user_id % 2 = 0")
    return rows.select(F.lit("activity").alias("graph_id"), F.concat(F.lit("Group#"), (F.col("user_id") % 7).cast("string")).alias("rep"), F.concat(F.lit("User#"), F.col("user_id").cast("string")).alias("member")).distinct()


@_query(f"""WITH {fx.ACTIVITY}, {_EDGES}, {DEG.format('act')}, {_CLUSTERS},
nb AS (SELECT name, string_agg(x, '|' ORDER BY lower(x), x) AS neighbors FROM (SELECT s AS name, o AS x FROM act UNION SELECT o, s FROM act) GROUP BY name),
inc AS (SELECT o AS name, string_agg('e' || n, '|' ORDER BY n) AS incoming FROM edges GROUP BY o), outg AS (SELECT s AS name, string_agg('e' || n, '|' ORDER BY n) AS outgoing FROM edges GROUP BY s),
k AS (SELECT rep, {_color_sql("'entity::' || rep")} AS color FROM (SELECT DISTINCT rep FROM cl))
SELECT 'activity' AS graph_id, name, rep AS cluster, coalesce(color, '#64748b') AS color, degree, in_degree, out_degree, false AS is_representative, (18 + 2 * least(degree, 8))::BIGINT AS radius,
neighbors, coalesce(incoming, '') AS incoming, coalesce(outgoing, '') AS outgoing
FROM deg JOIN nb USING (name) LEFT JOIN inc USING (name) LEFT JOIN outg USING (name) LEFT JOIN cl ON member = name LEFT JOIN k USING (rep)""")
def node_view(spark, d):
    g = _act(spark, d)
    nodes = analytics.node_view(KGFrames(g.entities, g.predicates, g.triples, _clusters(spark, d)))
    return nodes.withColumns({c: F.array_join(c, "|") for c in ("neighbors", "incoming", "outgoing")}).withColumn("radius", F.col("radius").cast("long"))


@_query(f"""WITH {_CLUSTERS}, m AS (SELECT rep, member FROM cl UNION SELECT DISTINCT rep, rep FROM cl), a AS (SELECT rep, string_agg(member, '|' ORDER BY lower(member), member) AS members, count(*)::INT AS size FROM m GROUP BY rep)
SELECT 'activity' AS graph_id, rep AS id, members, size, {_color_sql("'entity::' || rep")} AS color FROM a""")
def cluster_view(spark, d):
    return analytics.cluster_view(_clusters(spark, d)).withColumn("members", F.array_join("members", "|"))


_BOTH = f"{fx.KG}, {fx.ACTIVITY}, t AS (SELECT * FROM kg WHERE p <> 'has type' AND p <> 'based in' UNION SELECT * FROM act), e AS (SELECT s AS a, o AS b FROM t UNION SELECT o, s FROM t)"
_COMPONENTS = """r(name, component) USING KEY (name) AS (SELECT a, a FROM (SELECT DISTINCT a FROM e)
UNION (SELECT e.a, min(n.component) FROM e JOIN r n ON n.name = e.b JOIN recurring.r m ON m.name = e.a WHERE n.component < m.component GROUP BY e.a))"""


def _both(spark, d):
    """The triples of both graphs that leave several components, as one graph."""
    kg = fx.kg(spark, d).where("p <> 'has type' and p <> 'based in'")
    return graph.build(kg.unionByName(fx.activity(spark, d)).withColumn("graph_id", F.lit("all")))


@_query(f"WITH RECURSIVE {_BOTH}, {_COMPONENTS} SELECT 'all' AS graph_id, name, component FROM r")
def connected_components(spark, d):
    return analytics.graph_components(_both(spark, d))


@_query(f"WITH RECURSIVE {_BOTH}, {_COMPONENTS}, z AS (SELECT component, count(*) AS size FROM r GROUP BY component) SELECT 'all' AS graph_id, component, size, row_number() OVER (ORDER BY size DESC, component)::INT AS rank FROM z")
def component_sizes(spark, d):
    return analytics.component_sizes(_both(spark, d))


@_query(f"""WITH RECURSIVE {_BOTH}, {_COMPONENTS}, {{_CLUSTERS}}, n AS (SELECT count(*) AS n, count(DISTINCT component) AS c FROM r)
SELECT 'all' AS graph_id, n AS entities, count(*) AS relations, count(DISTINCT p) AS predicates, 0::BIGINT AS isolated, round(2.0 * count(*) / n, 2)::DOUBLE AS average_degree, round(count(*)::DOUBLE / (n * (n - 1)), 3) AS density, c AS components,
(SELECT count(DISTINCT rep) FROM cl) AS entity_clusters, 0::BIGINT AS edge_clusters FROM t, n GROUP BY n, c""".replace("{_CLUSTERS}", _CLUSTERS))
def graph_stats_full(spark, d):
    g = _both(spark, d)
    return analytics.full_statistics(KGFrames(g.entities, g.predicates, g.triples, _clusters(spark, d).withColumn("graph_id", F.lit("all"))))


@_query(f"""WITH {fx.ACTIVITY} SELECT 'activity' AS graph_id, name, string_agg(x, '|' ORDER BY lower(x), x) AS neighbors FROM (SELECT s AS name, o AS x FROM act UNION SELECT o, s FROM act) GROUP BY name""")
def neighbors_list(spark, d):
    return analytics.neighbors(fx.activity(spark, d)).withColumn("neighbors", F.array_join("neighbors", "|"))


# --- text -------------------------------------------------------------------------------------


@_query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role || ': ' || text) AS text FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id")
def conversation_flatten(spark, d):
    return chunks.flatten(fx.table(spark, d, "conversations"))


@_query("SELECT conv_id, turn, role || ': ' || text AS line FROM conversations WHERE role IN ('user', 'assistant')")
def message_role_filter(spark, d):
    return chunks.message_lines(fx.table(spark, d, "conversations"))


@_query("SELECT conv_id, turn FROM (SELECT conv_id, turn, CASE WHEN turn % 5 = 3 THEN 'tool' ELSE role END AS role FROM conversations) WHERE role NOT IN ('user', 'assistant', 'system')")
def message_validation(spark, d):
    odd = fx.table(spark, d, "conversations").withColumn("role", F.when(F.col("turn") % 5 == 3, "tool").otherwise(F.col("role")))
    return chunks.invalid_messages(odd).select("conv_id", "turn")


@_query("""WITH x AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?\\n]+[.!?]*')) AS s, generate_subscripts(regexp_extract_all(text, '[^.!?\\n]+[.!?]*'), 1) AS i FROM documents),
y AS (SELECT doc_id, i, trim(s, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS sentence FROM x)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS pos, sentence FROM y WHERE sentence <> ''""")
def sentence_split(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", F.posexplode(chunks.sentences(F.col("text"))).alias("pos", "sentence"))


_STRIPPED = "regexp_replace(raw, '^[' || o || ']+|[' || c || ']+$', '', 'g')"
_BRACKETS = "(SELECT '\"''(\\[{«„“‘' AS o, '\"'')\\]}»”’,;:' AS c)"


@_query(f"""WITH r AS (SELECT unnest(regexp_extract_all(text, '\\S+')) AS raw FROM documents), b AS (SELECT {_STRIPPED} AS bare FROM r, {_BRACKETS}),
t AS (SELECT bare, lower(regexp_replace(bare, '[.!?]+$', '')) AS w0 FROM b), u AS (SELECT CASE WHEN regexp_full_match(w0, '[0-9][0-9.,-]*') THEN '##' ELSE w0 END AS w, bare LIKE '%.' AND bare NOT LIKE '%..' AS dot FROM t WHERE w0 <> ''),
c AS (SELECT w, count(*) AS n, count(*) FILTER (WHERE dot) AS n_dot FROM u GROUP BY w), s AS (SELECT sum(n_dot) / sum(n) AS p FROM c),
f AS (SELECT w, n, n_dot, p, length(replace(w, '.', '')) AS l FROM c, s WHERE n_dot > 0 AND regexp_matches(w, '\\pL'))
SELECT w, n, n_dot, round(2 * (n_dot * (ln(0.99) - ln(p)) + (n - n_dot) * (ln(0.01) - ln(1 - p))) * exp(-l) * (length(w) - l + 1) * pow(l, n_dot - n), 6) + 0.0 AS score FROM f""")
def abbreviation_scores(spark, d):
    """How closely periods stick to words: what the trained splitter takes for abbreviations."""
    counts = sentences.type_counts(fx.table(spark, d, "documents"))
    return sentences.abbreviation_scores(counts).withColumn("score", F.round("score", 6) + F.lit(0.0))  # no negative zero


@_query()
def sentence_split_trained(spark, d):
    """Sentences of all documents by a splitter that has learned from all of them."""
    docs = fx.table(spark, d, "documents")
    found = sentences.split(docs, sentences.learn(docs), "doc_id")
    return found.select("doc_id", F.posexplode("sentences").alias("pos", "sentence"))


def _chunks_sql(size: int) -> str:
    """Greedy packing as a fold: each sentence, and each word of a long one, is a state that holds it in its buffer."""
    state = lambda out, buf: f"{{'out': {out}, 'buf': {buf}}}"
    strip = lambda x: f"trim({x}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))"
    full = lambda a, b: f"length({a}.buf) + length({b}.buf) + 1 > {size}"
    flushed = lambda a: f"CASE WHEN length({a}.buf) > 0 THEN list_append({a}.out, {strip(a + '.buf')}) ELSE {a}.out END"
    each = lambda words: f"list_transform({words}, lambda w: {state('[]::VARCHAR[]', 'w')})"
    more = lambda a, b, out, keep: state(f"CASE WHEN {full(a, b)} THEN {out} ELSE {a}.out END", f"CASE WHEN {full(a, b)} THEN {keep} ELSE {a}.buf || {b}.buf || ' ' END")
    start = f"[{state('[]::VARCHAR[]', chr(39) * 2)}]"
    word = more("v", "w", f"list_append(v.out, {strip('v.buf')})", "w.buf || ' '")
    packed = f"list_reduce({start} || {each('regexp_extract_all(s, ' + chr(39) + chr(92) + 'S+' + chr(39) + ')')}, lambda v, w: {word})"
    long = "length(y.buf) > " + str(size)
    sentence = more("x", "y", f"CASE WHEN {long} THEN ({flushed('x')}) || y.out ELSE {flushed('x')} END", f"CASE WHEN {long} THEN '' ELSE y.buf || ' ' END")
    return f"""WITH x AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?\\n]+[.!?]*')) AS s, generate_subscripts(regexp_extract_all(text, '[^.!?\\n]+[.!?]*'), 1) AS i FROM documents),
y AS (SELECT doc_id, i, {strip('s')} AS s FROM x), z AS (SELECT doc_id, i, s, CASE WHEN length(s) > {size} THEN {packed} END AS v FROM y WHERE s <> ''),
l AS (SELECT doc_id, list({state(f"CASE WHEN v IS NULL THEN []::VARCHAR[] ELSE {flushed('v')} END", 's')} ORDER BY i) AS l FROM z GROUP BY doc_id),
f AS (SELECT doc_id, list_reduce({start} || l, lambda x, y: {sentence}) AS v FROM l), c AS (SELECT doc_id, {flushed('v')} AS c FROM f)
SELECT doc_id, unnest(c) AS text, (generate_subscripts(c, 1) - 1)::INT AS chunk_id FROM c"""


@_query(_chunks_sql(500))
def chunk_text_500(spark, d):
    return chunks.chunks(fx.table(spark, d, "documents"), 500)


@_query("SELECT doc_id, len(regexp_extract_all(text, '\\S+'))::INT AS n_words FROM documents")
def word_counts(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", F.size(tx.words(F.col("text"))).alias("n_words"))


_LINES = "lines AS (SELECT s, p, o, '- ' || s || CASE hash_ WHEN 0 THEN ' | ' WHEN 1 THEN chr(9) ELSE ' -> ' END || p || CASE hash_ WHEN 0 THEN ' | ' WHEN 1 THEN chr(9) ELSE ' -> ' END || CASE WHEN length(s) % 5 = 0 THEN '' ELSE o END || ' ' AS line FROM (SELECT *, length(s || o) % 3 AS hash_ FROM kg))"


@_query(f"WITH {fx.KG}, {_LINES} SELECT line, CASE WHEN length(s) % 5 = 0 THEN NULL ELSE s END AS ps, CASE WHEN length(s) % 5 = 0 THEN NULL ELSE p END AS pp, CASE WHEN length(s) % 5 = 0 THEN NULL ELSE o END AS po FROM lines")
def relation_line_parse(spark, d):
    gap = F.when((F.length("s") + F.length("o")) % 3 == 0, " | ").when((F.length("s") + F.length("o")) % 3 == 1, "\t").otherwise(" -> ")
    line = F.concat(F.lit("- "), "s", gap, "p", gap, F.when(F.length("s") % 5 == 0, "").otherwise(F.col("o")), F.lit(" "))
    got = fx.kg(spark, d).select(line.alias("line")).withColumn("t", parse.relation_line(F.col("line")))
    return got.select("line", F.col("t.s").alias("ps"), F.col("t.p").alias("pp"), F.col("t.o").alias("po"))


@_query("SELECT n_nationkey, n_name || '|' || r_name AS entities FROM nation JOIN region ON n_regionkey = r_regionkey")
def parse_entities_json(spark, d):
    rows = fx.table(spark, d, "nation").join(fx.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    answer = F.concat(F.lit("Sure. <answer>```json\n[\""), "n_name", F.lit('", 1, " '), "r_name", F.lit(' ", "", null, "'), "n_name", F.lit('", {"a": 2}]\n```</answer> done'))
    return rows.select("n_nationkey", F.array_join(parse.entities(answer), "|").alias("entities"))


@_query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 2 THEN '' ELSE n_name || '>part of>' || r_name END AS relations FROM nation JOIN region ON n_regionkey = r_regionkey")
def parse_relations_json(spark, d):
    rows = fx.table(spark, d, "nation").join(fx.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    triple = F.concat(F.lit('[["'), "n_name", F.lit('", "part of", " '), "r_name", F.lit('"], ["a", "b"], ["", "b", "c"], [1, "b", "c"], ["'), "n_name", F.lit('", "part of", "'), "r_name", F.lit('"]]'))
    kind = F.col("n_nationkey") % 3
    answer = F.when(kind == 0, F.concat(F.lit('{"relations": '), triple, F.lit("}"))).when(kind == 1, F.concat(F.lit('<answer>{"triple": '), triple, F.lit("}</answer>"))).otherwise(F.concat(F.lit('{"relations": null, "triple": '), triple, F.lit("}")))
    return rows.select("n_nationkey", F.array_join(F.transform(parse.relations(answer), lambda r: F.array_join(r, ">")), "|").alias("relations"))


@_query("SELECT n_nationkey, n_name || '>>x|y>z>y' AS triples FROM nation")
def record_existing_triples(spark, d):
    record = F.concat(F.lit('{"text": "t", "triple": [["'), "n_name", F.lit('", " ", "x"], ["a", 1, "b"], ["y", "z ", "y"]]}'))
    return fx.table(spark, d, "nation").select("n_nationkey", F.array_join(F.transform(parse.existing_triples(record), lambda r: F.array_join(r, ">")), "|").alias("triples"))


@_query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN lang ELSE '' END AS text FROM documents")
def record_text_select(spark, d):
    k = F.col("doc_id") % 3
    raw, text = F.when(k == 0, F.col("source")).when(k == 1, F.lit("  ")), F.when(k < 2, F.col("lang")).otherwise(F.lit("\t"))
    return fx.table(spark, d, "documents").select("doc_id", parse.record_text(raw, text).alias("text"))


# --- names ------------------------------------------------------------------------------------

_PART_NAMES = "pn AS (SELECT p_partkey % 3 AS k, p_name || ' no. ' || (p_partkey // 30) || ' widget' AS n FROM part), nm AS (SELECT DISTINCT CASE k WHEN 0 THEN n || 's' WHEN 1 THEN '  ' || n || ' ' ELSE n END AS name FROM pn)"


def _part_names(spark, d):
    """Names of all parts in three spellings; parts of one name and number have one normal form."""
    k, n = F.col("p_partkey") % 3, F.concat("p_name", F.lit(" no. "), F.floor(F.col("p_partkey") / 30).cast("string"), F.lit(" widget"))
    name = F.when(k == 0, F.concat(n, F.lit("s"))).when(k == 1, F.concat(F.lit("  "), n, F.lit(" "))).otherwise(n)
    return fx.table(spark, d, "part").select(F.lit("parts").alias("graph_id"), name.alias("name")).distinct()


_SINGULAR = """CASE WHEN length(w) > 4 AND lower(w) LIKE '%ies' THEN w[:-4] || 'y' WHEN length(w) > 4 AND regexp_matches(lower(w), '(ss|sh|ch|x|z)es$') THEN w[:-3]
 WHEN length(w) > 3 AND lower(w) LIKE '%s' AND NOT regexp_matches(lower(w), '(ss|us|is)$') THEN w[:-2] ELSE w END"""
_NORMS = f"nf AS (SELECT name, array_to_string(list_transform(regexp_extract_all(name, '\\S+'), lambda w: {_SINGULAR}), ' ') AS norm FROM nm), cc AS (SELECT name, norm, min(name) OVER (PARTITION BY norm) AS chosen FROM nf)"


@_query(f"WITH {_PART_NAMES}, {_NORMS} SELECT 'parts' AS graph_id, name, norm, chosen FROM cc")
def normalize_collapse(spark, d):
    return dedupe.collapse(_part_names(spark, d))


@_query(f"WITH {_PART_NAMES}, {_NORMS} SELECT 'parts' AS graph_id, count(*) AS total, count(DISTINCT chosen) AS kept, count(*) - count(DISTINCT chosen) AS duplicates, round(100.0::DOUBLE * (count(*) - count(DISTINCT chosen)) / count(*), 1) AS reduction FROM cc")
def dedup_stats(spark, d):
    return dedupe.statistics(dedupe.collapse(_part_names(spark, d)))


@_query(f"""WITH {fx.ACTIVITY} SELECT DISTINCT 'activity' AS graph_id, 'User#' || (replace(s, 'User#', '')::INT % 10) AS s, upper(p) AS p, o FROM act""")
def rewrite_triples(spark, d):
    act = fx.activity(spark, d)
    users = act.select("graph_id", F.col("s").alias("name")).distinct().withColumn("chosen", F.concat(F.lit("User#"), (F.regexp_replace("name", "User#", "").cast("int") % 10).cast("string")))
    kinds = act.select("graph_id", F.col("p").alias("name")).distinct().withColumn("chosen", F.upper("name"))
    return dedupe.rewrite(act, users, kinds)


_ORDERED = "oc AS (SELECT DISTINCT 'Item#' || (k % 5) AS rep, 'Item#' || k AS member, k % 5 AS ord FROM (SELECT json_extract_string(props, '$.k')::INT AS k FROM events) UNION SELECT DISTINCT 'Item#' || (5 + k % 3), 'Item#' || k, 5 + k % 3 FROM (SELECT json_extract_string(props, '$.k')::INT AS k FROM events))"


@_query(f"""WITH {fx.ACTIVITY}, {_ORDERED}, fm AS (SELECT member, arg_min(rep, ord) AS chosen FROM oc WHERE member NOT IN (SELECT rep FROM oc) GROUP BY member)
SELECT DISTINCT 'activity' AS graph_id, s, p, coalesce(chosen, o) AS o FROM act LEFT JOIN fm ON o = member""")
def cluster_rewrite_first_match(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    keys = fx.table(spark, d, "events").select(F.lit("activity").alias("graph_id"), k.alias("k")).distinct()
    item = lambda x: F.concat(F.lit("Item#"), x.cast("string"))
    part = lambda o: keys.select("graph_id", o.alias("ord"), item(o).alias("rep"), item(F.col("k")).alias("member"))
    clusters = part(F.col("k") % 5).unionByName(part(5 + F.col("k") % 3)).distinct()
    act = fx.activity(spark, d)
    return dedupe.rewrite(act, dedupe.first_match(clusters), act.select("graph_id", F.col("p").alias("name"), F.col("p").alias("chosen")).distinct())


@_query()
def semantic_dedup(spark, d):
    """(graph_id, name, chosen) of all rows of embeddings, named by vec_id, after similarity of the table's vectors."""
    vectors = fx.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("node"), "embedding")
    names = vectors.select(F.lit("embeddings").alias("graph_id"), F.col("node").alias("name"))
    return dedupe.semantic(names, lambda nodes: vectors.join(nodes, "node", "left_semi"), 0.95).select("graph_id", "name", "chosen")


@_query("WITH n AS (SELECT count(*) AS n FROM embeddings), k AS (SELECT unnest(range(0, CASE WHEN n <= 128 THEN 1 ELSE n // 128 + (n % 128 > 0)::INT END)) AS cluster, n FROM n) SELECT CASE WHEN n <= 128 THEN n WHEN cluster < n // 128 THEN 128 ELSE n % 128 END AS size, count(*) AS clusters FROM k GROUP BY 1")
def capacity_cluster_sizes(spark, d):
    vectors = fx.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("name"), "embedding")
    sizes = cluster.capacity_clusters(vectors).groupBy("cluster").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("clusters"))


#: k-means from the first names by key and names taken rank by rank, for tables of one level of the tree.
_CLUSTERS = """WITH RECURSIVE n AS (SELECT vec_id::VARCHAR AS name, md5(vec_id::VARCHAR) || vec_id::VARCHAR AS key, embedding::DOUBLE[] AS v, row_number() OVER (ORDER BY md5(vec_id::VARCHAR) || vec_id::VARCHAR) AS i FROM embeddings),
k AS (SELECT greatest(1, count(*) // 16)::INT AS k FROM n),
km AS (SELECT 0 AS t, (SELECT list(v ORDER BY i) FROM n, k WHERE i <= k) AS cs
  UNION ALL SELECT t + 1, (SELECT list(coalesce(mean, old) ORDER BY j)
    FROM (SELECT unnest(range(1, len(km.cs) + 1)) AS j, unnest(km.cs) AS old) o
    LEFT JOIN (SELECT j, list(x ORDER BY dim) AS mean FROM (SELECT j, dim, avg(x) AS x FROM (
      SELECT list_position(d, list_min(d)) AS j, unnest(range(1, len(v) + 1)) AS dim, unnest(v) AS x FROM (SELECT v, list_transform(km.cs, lambda c: round(list_distance(v, c), 9)) AS d FROM n)) GROUP BY j, dim) GROUP BY j) m USING (j))
  FROM km WHERE t < 20),
pref AS (SELECT name, key, list(j ORDER BY d, j) AS ord FROM (SELECT name, key, unnest(range(1, len(cs) + 1)) AS j, unnest(list_transform(cs, lambda c: round(list_distance(v, c), 9))) AS d FROM n, km WHERE t = 20) GROUP BY name, key),
r AS (SELECT 0 AS t, name, key, ord, NULL::BIGINT AS own FROM pref
  UNION ALL SELECT t + 1, name, key, ord, CASE WHEN own IS NOT NULL THEN own WHEN row_number() OVER (PARTITION BY coalesce(own, ord[t + 1]) ORDER BY own IS NULL, key) <= 16 THEN ord[t + 1] END FROM r, k WHERE t < k)
SELECT name, coalesce(own - 1, k)::BIGINT AS cluster FROM r, k WHERE t = k"""


@_query(_CLUSTERS)
def capacity_clusters(spark, d):
    """The cluster of each vector, of 16 at most."""
    vectors = fx.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("name"), "embedding")
    return cluster.capacity_clusters(vectors, 16)


# --- retrieval --------------------------------------------------------------------------------


def _asked(spark, d):
    return fx.table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.lit("activity").alias("graph_id"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


_COS = "list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[])"
_ASKED = "q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0)"
_BEST = f"best AS (SELECT query_id, name, {_COS} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {_COS} DESC, name)::INT AS rank FROM q, vec QUALIFY rank <= 8)"


@_query(f"WITH vec AS (SELECT vec_id::VARCHAR AS name, embedding FROM embeddings), {_ASKED}, {_BEST} SELECT query_id, name, rank, round(score, 6) AS score FROM best")
def cosine_topk(spark, d):
    nodes = fx.table(spark, d, "embeddings").select(F.lit("activity").alias("graph_id"), F.col("vec_id").cast("string").alias("name"), "embedding")
    return retrieve.relevant_nodes(_asked(spark, d), nodes, 8).select("query_id", "name", "rank", F.round("score", 6).alias("score"))


_BM25 = """docs AS (SELECT p_partkey::VARCHAR AS name, regexp_extract_all(lower(p_type || ' ' || p_name), '\\S+') AS w FROM part),
qs AS (SELECT p_partkey AS query_id, regexp_extract_all(lower(p_name || ' ' || p_type || ' ' || p_name), '\\S+') AS w FROM part WHERE p_partkey % 50 = 0),
st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM docs), fr AS (SELECT name, term, count(*) AS tf FROM (SELECT name, unnest(w) AS term FROM docs) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM fr GROUP BY term), w0 AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS w FROM df, st), w1 AS (SELECT term, CASE WHEN w < 0 THEN 0.25 * (SELECT avg(w) FROM w0) ELSE w END AS idf FROM w0),
bm AS (SELECT query_id, fr.name, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(docs.w) / avgdl))) AS score FROM (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest(w) AS term FROM qs) GROUP BY ALL) JOIN w1 USING (term) JOIN fr USING (term) JOIN docs USING (name), st GROUP BY ALL)"""


def _index(spark, d):
    """The index of the parts' texts, and the texts that are asked."""
    part = fx.table(spark, d, "part")
    corpus = part.select(F.col("p_partkey").cast("string").alias("name"), F.concat_ws(" ", "p_type", "p_name").alias("text"))
    asked = part.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_name", "p_type", "p_name").alias("text"))
    return lexical.build(corpus), asked


@_query(f"WITH {_BM25} SELECT query_id, name, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, name)::INT AS rank FROM bm QUALIFY rank <= 16")
def bm25_topk(spark, d):
    return lexical.bm25_top_k(*_index(spark, d), 16)[0].select("query_id", "name", "score", "rank")


@_query(f"""WITH {_BM25}, e AS (SELECT vec_id::VARCHAR AS name, embedding FROM embeddings), q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
h AS (SELECT query_id, name, round(0.5 * coalesce(bm.score, 0) + 0.5 * {_COS}, 6) AS score FROM (SELECT * FROM q, e) LEFT JOIN bm USING (query_id, name))
SELECT query_id, name, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name)::INT AS rank FROM h QUALIFY rank <= 16""")
def hybrid_topk(spark, d):
    e = fx.table(spark, d, "embeddings").withColumn("graph_id", F.lit("parts"))
    asked = e.where("vec_id % 50 = 0").select("graph_id", F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    nodes = e.select("graph_id", F.col("vec_id").cast("string").alias("name"), "embedding")
    return lexical.hybrid_top_k(*_index(spark, d), asked, nodes)[0].select("query_id", "name", "score", "rank")


_DI = "di AS (SELECT s, o, max(p) AS r FROM act GROUP BY s, o), sym AS (SELECT s AS a, o AS b FROM di UNION SELECT o, s FROM di)"


def _khop(depth: int) -> str:
    hops = ["h0 AS (SELECT DISTINCT user_id AS query_id, 'User#' || user_id AS name FROM events WHERE user_id % 50 = 0)"]
    hops += [f"h{i} AS (SELECT query_id, name FROM h{i - 1} UNION SELECT query_id, b FROM h{i - 1} JOIN sym ON a = name)" for i in range(1, depth)]
    return f"WITH {fx.ACTIVITY}, {_DI}, {', '.join(hops)} SELECT DISTINCT 'activity' AS graph_id, query_id, s || ' ' || r || ' ' || o || '.' AS sentence FROM di JOIN h{depth - 1} ON name = s OR name = o"


def _context(spark, d, depth):
    """The contexts of every fiftieth user."""
    users = fx.table(spark, d, "events").where("user_id % 50 = 0").select("user_id").distinct()
    seeds = users.select(F.lit("activity").alias("graph_id"), F.col("user_id").alias("query_id"), F.concat(F.lit("User#"), F.col("user_id").cast("string")).alias("name"))
    return retrieve.context(seeds, fx.activity(spark, d), depth)


@_query(_khop(1))
def khop_context_1(spark, d):
    return _context(spark, d, 1)


@_query(_khop(2))
def khop_context_2(spark, d):
    return _context(spark, d, 2)


@_query(_khop(3))
def khop_context_3(spark, d):
    return _context(spark, d, 3)


@_query(f"""WITH {fx.ACTIVITY}, {_DI}, {fx.VECTORS}, {_ASKED}, {_BEST}, fr AS (SELECT query_id, name FROM best UNION SELECT query_id, b FROM best JOIN sym ON a = name),
c AS (SELECT DISTINCT query_id, s || ' ' || r || ' ' || o || '.' AS t FROM di JOIN fr ON name = s OR name = o), g AS (SELECT query_id, count(*) AS n, sum(length(t)) + count(*) - 1 AS chars, sum(len(regexp_extract_all(t, '\\S+'))) AS words FROM c GROUP BY query_id)
SELECT 'activity' AS graph_id, query_id, 8 AS top_k, 2 AS depth, (SELECT count(*) FROM best b WHERE b.query_id = g.query_id) AS retrieved_node_count, n AS retrieved_context_edge_count, chars::BIGINT AS retrieved_context_char_length, words::BIGINT AS retrieved_context_word_count FROM g""")
def retrieve_context_stats(spark, d):
    act = fx.activity(spark, d)
    return retrieve.retrieved_sizes(_asked(spark, d), fx.node_vectors(spark, d, act), act, 8, 2)


# --- evaluation -------------------------------------------------------------------------------

_ROLL = "count(*) AS total_facts, count(score) AS scored_facts, coalesce(sum(score), 0)::BIGINT AS correct_facts, count(*) FILTER (WHERE status = 'service_error') AS service_error_facts, count(*) FILTER (WHERE status = 'error') AS error_facts, CASE WHEN count(score) = 0 THEN 0.0 ELSE round(sum(score)::DOUBLE / count(score), 6) END AS accuracy"


@_query(f"WITH {fx.FACTS} SELECT item_id, quality_level, (row_number() OVER (PARTITION BY item_id, quality_level ORDER BY fact_pos) - 1)::INT AS fact_pos, fact, difficulty FROM facts")
def facts_flatten(spark, d):
    """Facts nested into items and flattened again."""
    rows = fx.facts(spark, d)
    fact = F.struct("fact_pos", "fact", "difficulty")
    lists = rows.groupBy("item_id", "quality_level").agg(F.transform(F.array_sort(F.collect_list(fact)), lambda f: F.struct(f["fact"].alias("fact"), f["difficulty"].alias("difficulty"))).alias("l"))
    items = lists.groupBy(F.col("item_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("quality_level", "l"))).alias("relational_facts"))
    return evaluate.flatten_facts(items)


@_query(f"WITH {fx.FACTS} SELECT item_id, {_ROLL} FROM facts GROUP BY item_id")
def item_stats(spark, d):
    return evaluate.item_stats(fx.facts(spark, d))


@_query(f"WITH {fx.FACTS} SELECT {_ROLL} FROM facts")
def overall_stats(spark, d):
    return evaluate.overall_stats(fx.facts(spark, d))


@_query(f"WITH {fx.FACTS} SELECT difficulty, {_ROLL} FROM facts WHERE difficulty IN ('easy', 'medium', 'hard') GROUP BY difficulty")
def difficulty_breakdown(spark, d):
    return evaluate.difficulty_breakdown(fx.facts(spark, d))


@_query(f"WITH {fx.FACTS}, i AS (SELECT DISTINCT (doc_id // 16)::VARCHAR AS item_id FROM documents) SELECT item_id, coalesce(bool_and(score IS NOT NULL) FILTER (WHERE fact IS NOT NULL), false) AS done FROM i LEFT JOIN facts USING (item_id) GROUP BY item_id")
def items_fully_scored(spark, d):
    items = fx.table(spark, d, "documents").select((F.floor(F.col("doc_id") / 16)).cast("string").alias("item_id"))
    return evaluate.fully_scored(items, fx.facts(spark, d))


@_query(f"""WITH {fx.FACTS} SELECT item_id, quality_level, fact_pos, fact, difficulty, CASE WHEN fact_pos % 2 = 0 THEN score END AS score, CASE WHEN fact_pos % 2 = 0 THEN status END AS status FROM facts""")
def restore_progress(spark, d):
    facts = fx.facts(spark, d)
    earlier = facts.where("fact_pos % 2 = 0").withColumn("run", F.lit(2))
    older = facts.where("fact_pos % 4 = 0").withColumns({"run": F.lit(1), "score": F.lit(9), "status": F.lit("scored")})
    return evaluate.restore(facts, earlier.unionByName(older)).select("item_id", "quality_level", "fact_pos", "fact", "difficulty", "score", "status")


@_query(f"""SELECT event_id, event_id % 4 IN (0, 2) AS retryable FROM events""")
def retryable_errors(spark, d):
    k = F.col("event_id") % 4
    message = F.when(k == 0, "Request TIMEOUT after 5 s").when(k == 1, "bad value").when(k == 2, "HTTP 503 from upstream").otherwise("no such key")
    return fx.table(spark, d, "events").select("event_id", tx.retryable(F.lit("ValueError"), message).alias("retryable"))


@_query("SELECT sum(CASE WHEN doc_id % 3 < 2 THEN n_chars ELSE 0 END)::BIGINT AS prompt_tokens, sum(CASE WHEN doc_id % 3 < 2 THEN 7 ELSE 0 END)::BIGINT AS completion_tokens, sum(CASE WHEN doc_id % 3 = 0 THEN n_chars + 7 ELSE 0 END)::BIGINT AS total_tokens FROM documents")
def token_usage(spark, d):
    k, n = F.col("doc_id") % 3, F.col("n_chars")
    entry = lambda at, total: F.when(k == at, F.struct(n.alias("prompt_tokens"), F.lit(7).cast("long").alias("completion_tokens"), total.alias("total_tokens")))
    none = F.lit(None).cast("long")
    return evaluate.token_usage(fx.table(spark, d, "documents").select(entry(0, n + 7).alias("usage"), F.struct(entry(1, none).alias("usage")).alias("response")))


# --- sinks and pipelines ----------------------------------------------------------------------


@_query(f"WITH {fx.KG}, {fx.ACTIVITY} SELECT name, min(g) AS graph_name FROM (SELECT s AS name, 'kg' AS g FROM kg UNION ALL SELECT o, 'kg' FROM kg UNION ALL SELECT s, 'activity' FROM act UNION ALL SELECT o, 'activity' FROM act) GROUP BY name")
def property_graph_nodes(spark, d):
    a, b = graph.build(fx.kg(spark, d)), _act(spark, d)
    return sinks.property_nodes(KGFrames(a.entities.unionByName(b.entities), a.predicates, a.triples.unionByName(b.triples)))


@_query(f"WITH {fx.KG} SELECT s, upper(replace(replace(p, ' ', '_'), '-', '_')) AS rel_type, o, max(p) AS predicate FROM kg GROUP BY ALL")
def property_graph_rels(spark, d):
    return sinks.property_relationships(graph.build(fx.kg(spark, d)))


@_query(f"WITH {fx.KG} SELECT (SELECT count(DISTINCT name) FROM ({ENDS.format('kg')})) AS nodes, count(*) AS relationships, count(DISTINCT p) AS types FROM kg")
def external_graph_stats(spark, d):
    g = graph.build(fx.kg(spark, d))
    return sinks.property_stats(sinks.property_nodes(g), sinks.property_relationships(g))


_NEXT = "WITH n AS (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]{2,}') AS n FROM documents), p AS (SELECT doc_id, n, unnest(range(1, len(n))) AS i FROM n)"


@_query(f"{_NEXT} SELECT DISTINCT doc_id::VARCHAR AS graph_id, n[i] AS s, 'precedes' AS p, n[i + 1] AS o FROM p")
def extract_pipeline_rule_based(spark, d):
    return extract.rule_triples(fx.table(spark, d, "documents"))


@_query(f"{_NEXT} SELECT DISTINCT doc_id::VARCHAR AS graph_id, n[i] AS s, 'precedes' AS p, n[i + 1] AS o FROM p")
def generate_graphs(spark, d):
    """A graph for each document, by the whole run with the rule backend."""
    return extract.generate(fx.table(spark, d, "documents").select("doc_id", "text"), backends.RuleBackend()).triples


@_query(f"""WITH c AS ({_chunks_sql(300)}), n AS (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]{{2,}}') AS n FROM c), p AS (SELECT doc_id, n, unnest(range(1, len(n))) AS i FROM n)
SELECT DISTINCT doc_id::VARCHAR AS graph_id, n[i] AS s, 'precedes' AS p, n[i + 1] AS o FROM p""")
def generate_chunked(spark, d):
    """Graphs of documents whose chunks are asked one by one and merged: no triple crosses the border of two chunks."""
    return extract.generate(fx.table(spark, d, "documents").select("doc_id", "text"), backends.RuleBackend(), chunk_size=300).triples


@_query(f"{_NEXT} SELECT DISTINCT doc_id::VARCHAR AS graph_id, n[i] AS s, 'precedes' AS p, n[i + 1] AS o FROM p")
def generate_fallback(spark, d):
    """Graphs by a backend whose typed relations fail for every other text: lines are parsed instead, and those of unknown ends dropped."""
    return extract.generate(fx.table(spark, d, "documents").select("doc_id", "text"), fx.LinesBackend()).triples


@_query(f"""{_NEXT}, t AS (SELECT DISTINCT doc_id, n[i] || ' precedes ' || n[i + 1] AS fact FROM p WHERE doc_id IN (SELECT doc_id FROM documents WHERE length(text) % 7 <> 0))
SELECT doc_id AS id, 'triple' AS kind, fact FROM t UNION ALL SELECT doc_id, 'failure', stage FROM documents, (VALUES ('entities'), ('relations')) v(stage) WHERE length(text) % 7 = 0""")
def extract_rerun(spark, d):
    """Batch extraction by a backend that leaves every third text out at first, and every seventh always: triples, and failures by stage."""
    docs = fx.table(spark, d, "documents").where("doc_id is not null").select(F.col("doc_id").alias("id"), "text")
    found, failures = extract.extract(docs, fx.GapsBackend(), extract.ExtractConfig(rerun_rounds=2, rerun_backoff=0.0))
    triples = found.select("id", F.lit("triple").alias("kind"), F.explode("triples").alias("t")).select("id", "kind", F.array_join("t", " ").alias("fact"))
    return triples.unionByName(failures.select("id", F.lit("failure").alias("kind"), F.col("stage").alias("fact")))


@_query("""WITH m AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role || ': ' || text) AS text FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id)
SELECT DISTINCT conv_id::VARCHAR AS graph_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{2,}')) AS name FROM m""")
def generate_from_messages(spark, d):
    """The entities of a graph for each conversation."""
    messages = fx.table(spark, d, "conversations").where("text is not null and role is not null").select("conv_id", "turn", "role", "text")
    return extract.generate_from_messages(messages, backends.RuleBackend()).entities


@_query(f"{_NEXT} SELECT DISTINCT doc_id AS id, n[i] AS s, 'precedes' AS p, n[i + 1] AS o FROM p WHERE doc_id % 3 <> 0 OR n[i] <> 'The'")
def extract_records(spark, d):
    """Batch extraction of records; those of every third document have all triples that start with The already."""
    docs = fx.table(spark, d, "documents").where("doc_id is not null")
    had = extract.rule_triples(docs.where("doc_id % 3 = 0")).where("s = 'The'").groupBy(F.col("graph_id").cast("long").alias("doc_id")).agg(F.collect_list(F.array("s", "p", "o")).alias("triple"))
    values = docs.select("doc_id", "text").join(had, "doc_id", "left").select(F.col("doc_id").alias("id"), F.to_json(F.struct("text", "triple")).alias("value"))
    found, _ = extract.extract(extract.records_of(values), backends.RuleBackend())
    return found.select("id", F.explode("triples").alias("t")).select("id", *[F.get("t", F.lit(i)).alias(c) for i, c in enumerate("spo")])


@_query("""SELECT s_suppkey, '{"entities":["' || least(s_name, n_name) || '","' || greatest(s_name, n_name) || '"],"edges":["located in"],"relations":[["' || s_name || '","located in","' || n_name || '"]]}' AS extracted_kg FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def convert_records(spark, d):
    """Records of suppliers, their triple twice, converted to graphs."""
    rows = fx.table(spark, d, "supplier").join(fx.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    triple = F.array("s_name", F.lit("located in"), F.concat(F.lit(" "), "n_name"))
    values = rows.select("s_suppkey", F.to_json(F.struct("s_suppkey", F.array(triple, triple, F.array("s_name")).alias("triple"))).alias("value"))
    done = lifecycles.convert_records(values.select("value"))
    return done.select(F.get_json_object("value", "$.s_suppkey").cast("long").alias("s_suppkey"), "extracted_kg")


def _groups(spark, d):
    """Suppliers and their nations, in groups of a nation's suppliers of a hundred numbers."""
    rows = fx.table(spark, d, "supplier").join(fx.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.withColumn("group", F.concat("n_name", F.lit("/"), F.floor(F.col("s_suppkey") / 100).cast("string")))


_GROUPS = "g AS (SELECT n_name || '/' || (s_suppkey // 100) AS grp, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def _nations(spark, d):
    """Suppliers and their nations, a group for each nation, as large as it is."""
    return _groups(spark, d).withColumn("group", F.col("n_name"))


def _items(rows):
    """An item for each group: the graph of its suppliers, true facts under high and false ones under low."""
    none = [F.lit(None).cast(t).alias(c) for c, t in (("difficulty", "string"), ("kg_entailment_score", "int"), ("evaluation_status", "string"), ("error", "string"))]
    facts = lambda place: F.collect_list(F.struct(F.concat("s_name", F.lit(" located in "), place).alias("fact"), *none))
    level = lambda name, list_: F.struct(F.lit(name).alias("key"), list_.alias("value"))
    kg = F.struct(F.array_append(F.collect_set("s_name"), F.first("n_name")).alias("entities"), F.array(F.lit("located in")).alias("edges"), F.collect_set(F.array("s_name", F.lit("located in"), "n_name")).alias("relations"))
    levels = F.map_from_entries(F.array(level("high", facts(F.col("n_name"))), level("low", facts(F.lit("nowhere")))))
    return rows.groupBy(F.col("group").alias("id")).agg(kg.alias("extracted_kg"), levels.alias("relational_facts"))


@_query("""SELECT n_name AS item_id, 'high' AS quality_level, s_name || ' located in ' || n_name AS fact, 1 AS score, 'scored' AS status FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT n_name, 'low', s_name || ' located in nowhere', 0, 'scored' FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def evaluate_items(spark, d):
    """Each nation's graph against true and false facts of its suppliers: retrieved for, and judged by rule."""
    items = _items(_nations(spark, d))
    done = lifecycles.evaluate_items(items, cluster.hashing_embedder(), backends.RuleBackend())
    return done.select("item_id", "quality_level", "fact", "score", "status")


@_query("SELECT DISTINCT n_name AS graph_id, upper(s_name) AS s, 'LOCATED IN' AS p, n_name AS o FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def lm_deduplicate(spark, d):
    """Graphs of nations whose suppliers and predicate stand in two spellings, merged by the rule backend within bounded clusters."""
    spelled = F.explode(F.array(F.struct(F.col("s_name").alias("s"), F.lit("located in").alias("p")), F.struct(F.upper("s_name").alias("s"), F.lit("LOCATED IN").alias("p"))))
    triples = _nations(spark, d).select(F.col("group").alias("graph_id"), F.col("n_name").alias("o"), spelled.alias("x")).select("graph_id", "x.s", "x.p", "o")
    return cluster.lm_deduplicate(graph.build(triples), cluster.hashing_embedder(), backends.RuleBackend()).triples


def _spelled(spark, d, second):
    """The graphs of groups whose suppliers stand in two spellings each."""
    names = F.explode(F.array("s_name", second))
    return graph.build(_groups(spark, d).select(F.col("group").alias("graph_id"), names.alias("s"), F.lit("located in").alias("p"), F.col("n_name").alias("o")))


@_query(f"WITH {_GROUPS} SELECT grp AS graph_id, s_name AS s, 'located in' AS p, n_name AS o FROM g")
def deduplicate_semhash(spark, d):
    """Spellings that share a normal form become one; names that differ by a digit stay apart."""
    kg = _spelled(spark, d, F.translate("s_name", "Suplier", "Ｓｕｐｌｉｅｒ"))
    return dedupe.deduplicate(kg, "semhash", cluster.hashing_embedder(), threshold=0.9999).triples


@_query(f"WITH {_GROUPS} SELECT grp AS graph_id, upper(s_name) AS s, 'located in' AS p, n_name AS o FROM g")
def deduplicate_lm_based(spark, d):
    """Spellings that the backend calls the same, within bounded clusters."""
    return dedupe.cluster(_spelled(spark, d, F.upper("s_name")), method="lm_based", embed=cluster.hashing_embedder(), backend=backends.RuleBackend()).triples


@_query(f"WITH {_GROUPS} SELECT grp AS graph_id, upper(s_name) AS s, 'located in' AS p, n_name AS o FROM g")
def deduplicate_full(spark, d):
    """Spellings in full-width capitals: a shared normal form first, then what the backend calls the same."""
    kg = _spelled(spark, d, F.upper("s_name"))
    wide = kg.triples.withColumn("s", F.translate("s", "SUPLIER", "ＳＵＰＬＩＥＲ"))
    kg = graph.build(kg.triples.unionByName(wide))
    return dedupe.deduplicate(kg, "full", cluster.hashing_embedder(), backends.RuleBackend(), 0.9999).triples


@_query(f"""WITH {_GROUPS}, f AS (SELECT grp, n_name, 'high' AS quality_level, s_name || ' located in ' || n_name AS fact, 1 AS right_ FROM g UNION ALL SELECT grp, n_name, 'low', s_name || ' located in nowhere', 0 FROM g),
j AS (SELECT grp, n_name, quality_level, fact, CASE WHEN length(fact) % 3 > 0 THEN right_ END AS score FROM f),
n AS (SELECT grp, count(*) AS total, count(score) AS scored, coalesce(sum(score), 0)::BIGINT AS correct, count(*) - count(score) AS errors FROM j GROUP BY grp)
SELECT grp AS id, n_name AS title, total, scored, correct, errors, quality_level, fact, score, CASE WHEN score IS NULL THEN 'error' ELSE 'scored' END AS status, CASE WHEN score IS NULL THEN 'ValueError: no answer' END AS error FROM j JOIN n USING (grp)""")
def item_result_payload(spark, d):
    """The results of items judged by a backend that fails for a third of the facts' lengths: each item's statistics with each of its facts."""
    done = lifecycles.evaluate_items(_items(_groups(spark, d)), cluster.hashing_embedder(), fx.GapsBackend())
    titles = _groups(spark, d).groupBy(F.col("group").alias("item_id")).agg(F.first("n_name").alias("title"))
    rows = evaluate.item_results(done, titles).select("id", "title", "evaluation_stats", F.explode("fact_results").alias("r"))
    stats = [F.col(f"evaluation_stats.{c}").alias(n) for c, n in (("total_facts", "total"), ("scored_facts", "scored"), ("correct_facts", "correct"), ("error_facts", "errors"))]
    return rows.select("id", "title", *stats, "r.quality_level", "r.fact", F.col("r.kg_entailment_score").alias("score"), F.col("r.evaluation_status").alias("status"), "r.error")


# --- files, stores and streams ----------------------------------------------------------------


@_query(f"WITH {_GROUPS} SELECT grp AS graph_id, s_name AS s, 'located in' AS p, n_name AS o FROM g UNION SELECT grp, n_name, 'holds', s_name FROM g")
def graph_json_round_trip(spark, d):
    """The graphs of groups written as JSON documents by many tasks, and read again."""
    path = shared_path(spark, "graphs")
    pair = F.explode(F.array(F.struct(F.col("s_name").alias("s"), F.lit("located in").alias("p"), F.col("n_name").alias("o")), F.struct(F.col("n_name").alias("s"), F.lit("holds").alias("p"), F.col("s_name").alias("o"))))
    triples = _groups(spark, d).select(F.col("group").alias("graph_id"), pair.alias("x")).select("graph_id", "x.*")
    sinks.write_graphs(graph.build(triples), path)
    return json_records.graph_array(spark, path).triples


@_query(f"WITH {fx.PLACE} SELECT name FROM (SELECT s AS name FROM place UNION SELECT o FROM place) WHERE name >= 'K'")
def store_round_trip(spark, d):
    """Nodes of a graph uploaded twice to a property-graph store, by query."""
    sink = sinks.PropertyGraphSink(shared_path(spark, "store"))
    for _ in range(2):
        sink.upload(graph.build(fx.place(spark, d)))
    return property_graph.query_graph(spark, sink.path, "select name from {nodes} where name >= :low", low="K")


@_query(f"WITH {fx.ACTIVITY} SELECT 'activity' AS graph_id, s, p, o FROM act")
def stream_union(spark, d):
    """The union of two overlapping batches of triples, each streamed once, the second by a checkpoint of its own."""
    source, target = shared_path(spark, "source"), shared_path(spark, "target")
    act = fx.activity(spark, d)
    for number, part in enumerate((act.where("p < 'd'"), act)):
        part.write.parquet(f"{source}/{number}")
        incremental.union_stream(spark, f"{source}/{number}", target, shared_path(spark, "checkpoint")).awaitTermination()
    return incremental.union_table(spark, target)


@_query("""SELECT s_suppkey, '["' || s_name || '","located in","' || n_name || '"]' AS triple FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def convert_file(spark, d):
    """Arrays of records, in the files of many tasks, converted and written; the triple of each written graph."""
    rows = fx.table(spark, d, "supplier").join(fx.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    record = F.struct("s_suppkey", F.array(F.array("s_name", F.lit("located in"), "n_name")).alias("triple"))
    source, target = shared_path(spark, "records"), shared_path(spark, "converted")
    write_array(rows.select(F.to_json(record).alias("value")), source)
    lifecycles.convert_file(spark, source, target)
    return spark.read.text(target).select(F.get_json_object("value", "$.s_suppkey").cast("long").alias("s_suppkey"), F.get_json_object("value", "$.extracted_kg.relations[0]").alias("triple"))


@_query(f"{_NEXT} SELECT DISTINCT doc_id AS id, n[i] AS s, 'precedes' AS p, n[i + 1] AS o FROM p")
def extract_resumed(spark, d):
    """Extraction saved in slices: half of the documents by an earlier run, the others by the next."""
    docs, path = fx.table(spark, d, "documents").where("doc_id is not null").select(F.col("doc_id").alias("id"), "text"), shared_path(spark, "extracted")
    config = extract.ExtractConfig(save_interval=1000)
    for part in (docs.where("id % 2 = 0"), docs):
        lifecycles.extract_to(part, path, backends.RuleBackend(), config)
    return spark.read.parquet(path).select("id", F.explode("triple").alias("t")).select("id", *[F.get("t", F.lit(i)).alias(c) for i, c in enumerate("spo")])


@_query("SELECT 2 * count(*) AS total_facts, 2 * count(*) AS scored_facts, count(*) AS correct_facts, 0::BIGINT AS service_error_facts, 0::BIGINT AS error_facts, 0.5::DOUBLE AS accuracy FROM supplier")
def evaluate_dataset(spark, d):
    """Totals of arrays of items, evaluated and saved in slices; the second run brings back the scores of the first."""
    source, output = shared_path(spark, "dataset"), shared_path(spark, "results")
    write_array(_items(_groups(spark, d)).select(F.to_json(F.struct("*")).alias("value")), source)
    for _ in range(2):
        totals = lifecycles.evaluate_dataset(spark, source, output, cluster.hashing_embedder(), backends.RuleBackend(), save_interval=100)
    return totals


@_query("SELECT 'brands' AS graph_id, name, p_brand AS norm FROM (SELECT DISTINCT p_brand, translate(p_brand, 'Brand', 'Ｂｒａｎｄ') AS name FROM part)")
def nfkc_names(spark, d):
    """Normal forms of names in full-width letters."""
    wide = F.translate("p_brand", "Brand", "Ｂｒａｎｄ")
    names = fx.table(spark, d, "part").select(F.lit("brands").alias("graph_id"), wide.alias("name")).distinct()
    return dedupe.collapse(names).select("graph_id", "name", "norm")
