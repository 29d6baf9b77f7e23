"""Queries over text functions, predicates, scans and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import ids
from corpusloom.functions import text as tx
from corpusloom.operators import export, filters, line_diff, long_texts, ordered, polish, profile, ranking, sectioning, store
from corpusloom.plans import registry as r
from corpusloom.plans.registry import query, table, texts
from corpusloom.sources import day_files, tables


def doc_nodes(spark, d):
    """Documents seen as nodes: source is the file, the language is the header path."""
    return texts(spark, d).select(
        F.col("doc_id").alias("id"), F.col("source").alias("fname"),
        F.concat(F.lit("/"), F.col("lang"), F.lit("/")).alias("header_path"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("doc "), F.col("doc_id").cast("string"))).alias("title"),
        (F.col("doc_id") * 86_400_000).alias("ts_ms"), "text")


NODES_SQL = """nodes AS (SELECT doc_id id, source fname, '/' || lang || '/' header_path,
    CASE WHEN doc_id % 3 = 0 THEN 'doc ' || doc_id END title, doc_id * 86400000 ts_ms, text FROM documents)"""


def event_records(spark, d):
    ts = F.col("ts").cast("timestamp_ltz")
    return table(spark, d, "events").select("event_id", F.unix_millis(ts).alias("ts_ms"), "event_type", "props")


@query("normalize_text", "P1", f"SELECT doc_id, {r.normalize('text')} AS clean FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.normalize(F.col("text")).alias("clean"))


@query("clean_text", "P2", f"SELECT doc_id, {r.clean('text')} AS clean FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.clean_basic(F.col("text")).alias("clean"))


@query("stable_uid", "P3", f"""WITH {NODES_SQL}
    SELECT id, substr(sha256(text || header_path || fname || ts_ms::VARCHAR), 1, 32) AS uid FROM nodes""")
def _(spark, d):
    c = [F.col(x) for x in ("text", "header_path", "fname", "ts_ms")]
    return doc_nodes(spark, d).select("id", ids.stable_uid(*c).alias("uid"))


@query("stable_uid_blake2s", "P3")
def _(spark, d):
    c = [F.col(x) for x in ("text", "header_path", "fname", "ts_ms")]
    return doc_nodes(spark, d).select("id", ids.stable_uid_blake2s(*c).alias("uid"))


@query("fallback_uid", "P4", f"""WITH {NODES_SQL}
    SELECT id, 'n_' || substr(sha1(fname || '|' || header_path || '|1024|120|' || sha1(text)), 1, 24) AS uid FROM nodes""")
def _(spark, d):
    c = [F.col(x) for x in ("fname", "header_path", "text")]
    return doc_nodes(spark, d).select("id", ids.fallback_uid(*c).alias("uid"))


@query("iso_times", "P5", """SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') AS iso,
    strftime(ts, '%Y-%m-%d') AS day FROM events""")
def _(spark, d):
    e = event_records(spark, d)
    return e.select("event_id", tx.iso_seconds(F.col("ts_ms")).alias("iso"), tx.iso_date(F.col("ts_ms")).alias("day"))


@query("word_counts", "P6", f"SELECT doc_id, len({r.words('text')})::BIGINT AS words FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.word_count(F.col("text")).alias("words"))


@query("token_estimates", "P7 P8 X8", f"""SELECT doc_id, {r.tokens('text')} AS tokens_up,
    greatest(1, length(text) // 4)::BIGINT AS tokens_down FROM documents""")
def _(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", tx.tokens_ceil(t).alias("tokens_up"), tx.tokens_floor(t).alias("tokens_down"))


@query("shortened_texts", "P9", f"""SELECT doc_id, {r.shorten('text', 100, ' …')} AS preview,
    {r.shorten('text', 90, ' [...]')} AS snippet FROM documents""")
def _(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", tx.shorten(t, 100, tx.PREVIEW_PLACEHOLDER).alias("preview"), tx.shorten(t, 90).alias("snippet"))


@query("prefixes", "P10", """SELECT doc_id, substr(doc_id::VARCHAR, 1, 8) AS short_id, substr(source, 1, 40) AS short_title,
    substr(text, 1, 50) AS head FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", tx.prefix(F.col("doc_id").cast("string"), 8).alias("short_id"),
        tx.prefix(F.col("source"), 40).alias("short_title"), tx.prefix(F.col("text"), 50).alias("head"))


@query("header_names", "P11", """SELECT user_id, coalesce(CASE WHEN len(types) > 0 THEN types[1] END, 'untitled') AS header FROM (
    SELECT user_id, list_sort(list_distinct(list(CASE WHEN value < 0 THEN event_type END))) types FROM events GROUP BY user_id)""")
def _(spark, d):
    e = table(spark, d, "events")
    lists = e.groupBy("user_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("value") < 0, F.col("event_type")))).alias("types"))
    return lists.select("user_id", tx.header_of_list(F.col("types")).alias("header"))


@query("citation_labels", "P12", """SELECT conv_id, turn,
    coalesce(CASE WHEN role = 'system' THEN role END, CASE WHEN turn <> 0 THEN turn::VARCHAR END, 'node-' || (turn + 1)) AS label
    FROM conversations""")
def _(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", tx.citation_label(
        F.col("turn") + 1, F.when(F.col("role") == "system", F.col("role")), F.col("turn")).alias("label"))


@query("section_blocks", "P13", f"WITH {NODES_SQL} SELECT id, '### ' || header_path || chr(10) || text AS block FROM nodes")
def _(spark, d):
    return doc_nodes(spark, d).select("id", tx.section_block(F.col("header_path"), F.col("text")).alias("block"))


@query("passage_blocks", "P14", """SELECT item_id, '**Passage ' || (item_id + 1) || '** — ' || 'item-' || item_id || chr(10) || chr(10)
    || text || chr(10) AS block FROM benchmark""")
def _(spark, d):
    b = table(spark, d, "benchmark")
    label = F.concat(F.lit("item-"), F.col("item_id").cast("string"))
    return b.select("item_id", tx.passage_block(F.col("item_id") + 1, label, F.col("text")).alias("block"))


@query("flattened_lines", "P15", f"SELECT doc_id, {r.flat('text')} AS flat FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.flatten_lines(F.col("text")).alias("flat"))


@query("embedding_input", "P16", "SELECT doc_id, replace(text, chr(10), ' ') AS flat FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.newlines_to_spaces(F.col("text")).alias("flat"))


@query("missing_defaults", "P17", f"""WITH {NODES_SQL}
    SELECT id, coalesce(title, 'untitled') AS shown_title, coalesce(title, '') AS stored_title,
    coalesce(CASE WHEN id % 2 = 0 THEN header_path END, '/') AS path FROM nodes""")
def _(spark, d):
    n = doc_nodes(spark, d)
    return n.select("id", tx.title_or_default(F.col("title")).alias("shown_title"),
                    F.coalesce("title", F.lit("")).alias("stored_title"),
                    F.coalesce(F.when(F.col("id") % 2 == 0, F.col("header_path")), F.lit(tx.DEFAULT_HEADER_PATH)).alias("path"))


@query("changed_lines", "P18", f"""WITH t AS (SELECT doc_id id, replace(text, ' ', '  ') AS text FROM documents),
    ch AS (SELECT id, text, {r.clean('text')} AS clean FROM t WHERE {r.clean('text')} <> text),
    o AS (SELECT id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS old_line FROM ch),
    n AS (SELECT id, generate_subscripts(string_split(clean, chr(10)), 1) - 1 AS line_no, unnest(string_split(clean, chr(10))) AS new_line FROM ch)
    SELECT id, line_no::INT AS line_no, old_line, new_line FROM o FULL OUTER JOIN n USING (id, line_no)
    WHERE old_line IS DISTINCT FROM new_line""")
def _(spark, d):
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.replace("text", F.lit(" "), F.lit("  ")).alias("text"))
    return polish.line_changes(docs)


@query("line_edits", "P18")
def _(spark, d):
    """Changed lines by anchors: dropped blank lines at the beginning do not mark what follows."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("\n"), F.replace("text", F.lit(" "), F.lit("  "))).alias("old"))
    return line_diff.line_edits(t.withColumn("new", tx.clean_basic(F.col("old"))))


@query("line_edits_hold", "P18", f"""WITH t AS (SELECT doc_id id, chr(10) || text AS old, {r.clean('chr(10) || text')} AS new FROM documents WHERE text IS NOT NULL)
    SELECT id, len(string_split(new, chr(10)))::BIGINT AS n_lines, true AS whole FROM t""")
def _(spark, d):
    """Old lines less the dropped ones plus the added ones are the new lines."""
    t = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.concat(F.lit("\n"), F.col("text")).alias("old"))
    t = t.withColumn("new", tx.clean_basic(F.col("old")))
    edits = line_diff.line_edits(t).groupBy("id").agg(F.count("old_no").alias("dropped"), F.count("new_no").alias("added"))
    counted = t.select("id", F.size(F.split("old", "\n")).alias("lines"))  # the texts themselves are not joined
    n = (F.col("lines") - F.coalesce("dropped", F.lit(0)) + F.coalesce("added", F.lit(0))).cast("bigint")
    return counted.join(edits, "id", "left").select("id", n.alias("n_lines"), (F.coalesce("dropped", F.lit(0)) <= F.col("lines")).alias("whole"))


@query("polished_documents", "P19", f"""WITH n AS (SELECT source fname, doc_id id, {r.clean('text')} t,
    (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 1000 AS part FROM documents)
    SELECT fname, part, string_agg(t, chr(10) || chr(10) ORDER BY id) AS text, count(*) AS n_rows FROM n GROUP BY fname, part""")
def _(spark, d):
    return polish.polish_documents(doc_nodes(spark, d))


@query("prompts", "P20", """SELECT item_id, text || chr(10) || chr(10) || 'Answer tersely.' AS guarded,
    'Given Context: ' || text || ' Give the best full answer amongst the option to question ' || text AS qa,
    'Write a summary of the following, including as many key details as possible: ' || text || ':' AS summary FROM benchmark""")
def _(spark, d):
    t = F.col("text")
    return table(spark, d, "benchmark").select(
        "item_id", tx.with_instruction(t, "Answer tersely.").alias("guarded"),
        tx.qa_prompt(t, t).alias("qa"), tx.summary_prompt(t).alias("summary"))


# Predicates -----------------------------------------------------------------

@query("role_filter", "F1 S2", "SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'")
def _(spark, d):
    return table(spark, d, "conversations").where(filters.by_role(F.col("role"))).select("conv_id", "turn", "text")


@query("non_empty_texts", "F2", f"SELECT conv_id, turn FROM conversations WHERE length({r.strip('text')}) > 0")
def _(spark, d):
    return table(spark, d, "conversations").where(filters.non_empty(F.col("text"))).select("conv_id", "turn")


@query("multi_line_nodes", "F4", f"SELECT doc_id FROM documents WHERE contains({r.strip('text')}, chr(10))")
def _(spark, d):
    return table(spark, d, "documents").where(filters.multi_line(F.col("text"))).select("doc_id")


@query("length_guard", "F5", "SELECT doc_id, length(text) AS n FROM documents WHERE length(text) <= 20000")
def _(spark, d):
    t = table(spark, d, "documents").where(filters.not_too_long(F.col("text")))
    return t.select("doc_id", F.length("text").cast("bigint").alias("n"))


@query("keyword_filter", "F6", "SELECT doc_id FROM documents WHERE contains(lower(text), 'tion')")
def _(spark, d):
    return table(spark, d, "documents").where(filters.contains_keyword(F.col("text"), "TION")).select("doc_id")


@query("after_time", "F7", "SELECT event_id, epoch_us(ts) // 1000 AS ts_ms FROM events WHERE ts >= TIMESTAMP '2024-01-15'")
def _(spark, d):
    e = table(spark, d, "events")
    kept = e.where(filters.since(F.col("ts"), 1_705_276_800_000, e.schema["ts"].dataType.simpleString()))
    return kept.select("event_id", F.unix_millis(F.col("ts").cast("timestamp_ltz")).alias("ts_ms"))


@query("sanitized_metadata", "F12", """SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events
    WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def _(spark, d):
    m = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("gone"), F.lit(None).cast("string")))
    e = table(spark, d, "events").select("event_id", store.sanitize_map(m).alias("m"))
    return e.select("event_id", F.explode("m").alias("key", "value"))


# Scans ----------------------------------------------------------------------

@query("latest_day", "S4", """SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events
    WHERE strftime(ts, '%Y-%m-%d') = (SELECT max(strftime(ts, '%Y-%m-%d')) FROM events)""")
def _(spark, d):
    e = event_records(spark, d).select("event_id", tx.iso_date(F.col("ts_ms")).alias("day"))
    return day_files.select_day(e)


@query("node_scan", "S5 D3 D4", f"""WITH {NODES_SQL}
    SELECT id, fname, header_path, title, ts_ms, text, len({r.words('text')})::BIGINT AS words FROM nodes""")
def _(spark, d):
    return tables.node_scan(doc_nodes(spark, d))


@query("store_nodes", "S7", f"""WITH {NODES_SQL} SELECT id,
    CASE WHEN id % 2 = 0 THEN fname ELSE 'f-' || fname END AS fname, CASE WHEN id % 5 = 0 THEN '/' ELSE header_path END AS header_path,
    coalesce(title, '') AS title, ts_ms, text, len({r.words('text')})::BIGINT AS words FROM nodes""")
def _(spark, d):
    n = doc_nodes(spark, d)
    odd = F.col("id") % 2 == 1
    meta = F.create_map(
        F.lit("fname"), F.when(odd, F.lit("")).otherwise(F.col("fname")),
        F.lit("file"), F.concat(F.lit("f-"), F.col("fname")),
        F.lit("date"), F.when(F.col("id") % 5 != 0, F.col("header_path")),
        F.lit("title"), F.col("title"), F.lit("timestamp"), F.col("ts_ms").cast("string"))
    return tables.nodes_from_store(n.select("id", F.col("text").alias("document"), meta.alias("metadata")))


@query("key_values", "S8", "SELECT vec_id AS key, embedding::DOUBLE[] AS value FROM embeddings")
def _(spark, d):
    e = table(spark, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return tables.key_values(e, "vec_id", "embedding")


@query("docstore_scan", "S9 D11", f"WITH {NODES_SQL} SELECT id, text, header_path, fname AS file, ts_ms AS timestamp FROM nodes")
def _(spark, d):
    docs, _ = tables.flat_docstore(doc_nodes(spark, d))
    return docs.select("id", "text", "metadata.*")


@query("text_corpus", "S12", "SELECT doc_id, text FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def _conversation_records(spark, d):
    return table(spark, d, "conversations").select(
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"),
        F.lit(None).cast("string").alias("title"), (F.col("turn") * 1000).alias("timestamp"), "role",
        F.col("text").alias("content"), F.col("conv_id").alias("fname"), F.col("conv_id").alias("day"))


@query("day_render", "A3", """SELECT conv_id AS fname, 1 AS kind, turn * 1000 AS timestamp, conv_id || '-' || turn AS id,
      chr(10) || '## untitled' || chr(10) || CASE WHEN turn <> 0 THEN '### ' || strftime(make_timestamp(turn * 1000000), '%Y-%m-%dT%H:%M:%S') || chr(10) ELSE '' END || text AS block
    FROM conversations WHERE role = 'assistant'
    UNION ALL SELECT DISTINCT conv_id, 0, NULL, NULL, '# ' || conv_id FROM conversations""")
def _(spark, d):
    return day_files.day_blocks(_conversation_records(spark, d))


@query("all_files", "U6 S2", """SELECT source AS origin, count(*) AS n FROM (SELECT 'conversations' AS source FROM conversations
    UNION ALL SELECT source FROM documents) GROUP BY 1""")
def _(spark, d):
    a = table(spark, d, "conversations").select(F.lit("conversations").alias("origin"))
    b = table(spark, d, "documents").select(F.col("source").alias("origin"))
    return profile.rows_per(a.unionByName(b), "origin")


# Profiles and previews ------------------------------------------------------

@query("corpus_profile", "A1", f"""WITH {NODES_SQL}, w AS (SELECT len({r.words('text')}) w, title, ts_ms FROM nodes)
    SELECT count(*) AS documents, min(w)::BIGINT AS min_words, floor(quantile_cont(w, 0.5))::BIGINT AS median_words, max(w)::BIGINT AS max_words,
    count(title) AS titled, strftime(make_timestamp(min(CASE WHEN ts_ms <> 0 THEN ts_ms END) * 1000), '%Y-%m-%d') AS first_day,
    strftime(make_timestamp(max(ts_ms) * 1000), '%Y-%m-%d') AS last_day FROM w""")
def _(spark, d):
    return profile.profile(doc_nodes(spark, d))


@query("file_totals", "A2", """SELECT conv_id AS fname, count(*) AS n_total, count(*) FILTER (WHERE role = 'assistant') AS n_kept
    FROM conversations GROUP BY conv_id""")
def _(spark, d):
    return profile.file_totals(_conversation_records(spark, d))


@query("nodes_per_file", "A15", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def _(spark, d):
    return profile.rows_per(table(spark, d, "documents"), "source")


@query("node_preview", "W12", f"""WITH {NODES_SQL}
    SELECT substr(id::VARCHAR, 1, 8) AS node_id, len({r.words('text')})::BIGINT AS words, substr(coalesce(title, ''), 1, 40) AS title,
    ts_ms AS timestamp, {r.shorten('text', 100, ' …')} AS preview FROM (SELECT * FROM nodes ORDER BY id LIMIT 10)""")
def _(spark, d):
    return profile.preview(doc_nodes(spark, d))


@query("filtered_preview", "W13 F6 F7", f"""WITH {NODES_SQL}
    SELECT substr(id::VARCHAR, 1, 8) AS node_id, len({r.words('text')})::BIGINT AS words, substr(coalesce(title, ''), 1, 40) AS title,
    ts_ms AS timestamp, {r.shorten('text', 100, ' …')} AS preview FROM (
      SELECT * FROM nodes WHERE contains(lower(text), 'tion') AND ts_ms >= 8640000000 ORDER BY id LIMIT 50)""")
def _(spark, d):
    return profile.preview_filtered(doc_nodes(spark, d), keyword="tion", after_ms=8_640_000_000)


# Chunks and sections --------------------------------------------------------

CHUNKS_SQL = f"""WITH RECURSIVE s AS (
      SELECT doc_id, generate_subscripts(string_split_regex(text, '[.!?\\n]'), 1) i, unnest(string_split_regex(text, '[.!?\\n]')) s FROM documents),
    k AS (SELECT doc_id, i, s, {r.tokens("(' ' || s)")} n FROM s WHERE {r.strip('s')} <> ''),
    u AS (SELECT doc_id, i, 0 j, s t, n, 0 seg FROM k WHERE n <= 100
      UNION ALL SELECT doc_id, i, j, t, {r.tokens("(' ' || t)")}, i FROM (SELECT doc_id, i, generate_subscripts(p, 1) j, unnest(p) t FROM (
        SELECT doc_id, i, list_filter(list_transform(string_split_regex(s, '[,;:]'), lambda x: {r.strip('x')}), lambda x: x <> '') p FROM k WHERE n > 100))),
    o AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) p, t, n, seg FROM u),
    f AS (SELECT doc_id, p, t, n AS len, seg, 0::BIGINT AS c FROM o WHERE p = 1
      UNION ALL SELECT o.doc_id, o.p, o.t, CASE WHEN o.seg <> f.seg OR f.len + o.n > 100 THEN o.n ELSE f.len + o.n END, o.seg,
        CASE WHEN o.seg <> f.seg OR f.len + o.n > 100 THEN f.c + 1 ELSE f.c END FROM f JOIN o ON o.doc_id = f.doc_id AND o.p = f.p + 1)
    SELECT doc_id, c::INT AS chunk_no, string_agg(t, ' ' ORDER BY p) AS text FROM f GROUP BY doc_id, c"""


@query("text_chunks", "C3 C4 C18", CHUNKS_SQL)
def _(spark, d):
    return long_texts.split_texts(texts(spark, d), "doc_id")


# A unit (p) that a chunk begins with, where the chunk really begins (f, with the overlap) and its last unit.
@query("overlapping_chunks", "C2", f"""WITH RECURSIVE s AS (
      SELECT doc_id, generate_subscripts(x, 1) i, unnest(x) s FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?\n]*[.!?\n]+|[^.!?\n]+') x FROM documents)),
    k AS (SELECT doc_id, i, s, {r.tokens('s')} n FROM s WHERE {r.strip('s')} <> ''),
    u AS (SELECT doc_id, i, 0 j, s t, n FROM k WHERE n <= 1024
      UNION ALL SELECT doc_id, i, j, t, {r.tokens('t')} FROM (SELECT doc_id, i, generate_subscripts(w, 1) j, unnest(w) t FROM (
        SELECT doc_id, i, regexp_extract_all(s, '\\S+\\s*') w FROM k WHERE n > 1024))),
    o AS (SELECT doc_id, t, n, row_number() OVER w p, (sum(n) OVER w)::BIGINT e FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY i, j)),
    b AS (SELECT x.doc_id, x.p, min(y.p) f, arg_min(y.e - y.n, y.p) fs FROM o x JOIN o y ON y.doc_id = x.doc_id AND y.p <= x.p AND y.p >= x.p - 121
      AND (y.p = x.p OR (x.e - x.n) - (y.e - y.n) <= least(120, 1024 - x.n)) GROUP BY x.doc_id, x.p),
    l AS (SELECT b.doc_id, b.p, b.f, max(y.p) z FROM b JOIN o y ON y.doc_id = b.doc_id AND y.p >= b.p AND (y.p = b.p OR y.e <= b.fs + 1024) GROUP BY ALL),
    c AS (SELECT doc_id, 0 c, p, f, z FROM l WHERE p = 1 UNION ALL SELECT l.doc_id, c.c + 1, l.p, l.f, l.z FROM c JOIN l ON l.doc_id = c.doc_id AND l.p = c.z + 1)
    SELECT c.doc_id, c.c::INT AS chunk_no, {r.strip("string_agg(o.t, '' ORDER BY o.p)")} AS text
    FROM c JOIN o ON o.doc_id = c.doc_id AND o.p BETWEEN c.f AND c.z GROUP BY c.doc_id, c.c""")
def _(spark, d):
    return long_texts.overlapping_texts(texts(spark, d), "doc_id")


@query("markdown_sections", "C1", r"""WITH l AS (
      SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) p, unnest(string_split(text, chr(10))) s FROM documents),
    m AS (SELECT doc_id, p - 1 p, CASE WHEN p % 7 = 1 THEN '# ' || s WHEN p % 3 = 0 THEN '## ' || s ELSE s END s,
        CASE WHEN p % 7 = 1 THEN 1 WHEN p % 3 = 0 THEN 2 ELSE 0 END lv, s t FROM l),
    n AS (SELECT *, sum((lv > 0)::INT) OVER w no, max(CASE WHEN lv = 1 THEN p END) OVER w h1 FROM m
      WINDOW w AS (PARTITION BY doc_id ORDER BY p))
    SELECT n.doc_id, n.no::BIGINT AS section_no, regexp_replace(string_agg(n.s, chr(10) ORDER BY n.p), '^\s+|\s+$', '', 'g') AS text,
      max(CASE WHEN n.lv > 0 THEN n.lv END)::INT AS level, max(CASE WHEN n.lv > 0 THEN n.t END) AS header,
      coalesce(max(CASE WHEN n.lv = 1 THEN '/' WHEN n.lv = 2 THEN '/' || a.t || '/' END), '/') AS header_path
    FROM n LEFT JOIN m a ON a.doc_id = n.doc_id AND a.p = n.h1 GROUP BY n.doc_id, n.no""")
def _(spark, d):
    lines = sectioning.lines_of(texts(spark, d), "doc_id")
    line_no = F.col("pos") + 1
    marked = lines.withColumn("line", F.when(line_no % 7 == 1, F.concat(F.lit("# "), "line"))
                              .when(line_no % 3 == 0, F.concat(F.lit("## "), "line")).otherwise(F.col("line")))
    return sectioning.sections(marked, ["doc_id"])


@query("page_sections", "C1")
def _(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.regexp_replace("html", "(?i)<h1[^>]*>", "\n# ").alias("text"))
    return sectioning.sections(sectioning.lines_of(pages, "page_id"), ["page_id"])


# Report rows ----------------------------------------------------------------

@query("flat_export", "K1 P13", f"""WITH {NODES_SQL}
    SELECT len({r.words('text')})::BIGINT AS sort_key, id, '### ' || header_path || chr(10) || text AS block, true AS descending FROM nodes""")
def _(spark, d):
    return export.flat_blocks(tables.node_scan(doc_nodes(spark, d)), order="words", ascending=False)


@query("document_dump", "K4", f"WITH {NODES_SQL} SELECT text, id, fname, header_path, title, ts_ms FROM nodes")
def _(spark, d):
    return doc_nodes(spark, d).select("text", "id", "fname", "header_path", "title", "ts_ms")


@query("context_text", "A13 P15", f"""SELECT conv_id, part, string_agg({r.flat('text')} || chr(10) || chr(10), '' ORDER BY turn) AS context, count(*) AS n_selected
    FROM (SELECT conv_id, turn, text, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 1000 AS part FROM conversations) GROUP BY conv_id, part""")
def _(spark, d):
    return ranking.context_parts(table(spark, d, "conversations"), ["conv_id"], ["turn"])


@query("event_islands", "W8", """WITH f AS (SELECT event_id, ts, event_type,
      coalesce((event_type <> lag(event_type) OVER (ORDER BY ts, event_id))::INT, 1) s FROM events),
    g AS (SELECT *, sum(s) OVER (ORDER BY ts, event_id) group_no FROM f)
    SELECT group_no::BIGINT AS group_no, event_type, count(*) AS n, min(event_id) AS first_id FROM g GROUP BY ALL""")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "event_type")
    groups = ordered.contiguous_groups(e, "event_type", "ts", "event_id")
    return groups.groupBy("group_no", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))
