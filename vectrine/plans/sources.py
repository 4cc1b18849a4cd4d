"""Registered queries of sources, sinks and indexes: tables are written in a source's own form to the shared folder, and read by it."""

from __future__ import annotations

import warnings

from pyspark.sql import Window
from pyspark.sql import functions as F

from vectrine import index
from vectrine.functions import text as tx
from vectrine.functions import vector
from vectrine.operators import chunk, embed, evaluate, graph, knn, messages, passages, pq, relational
from vectrine.plans.catalog import _HASHED, _V, _asked, _ranked, _vectors, query, table
from vectrine.schema import Manifest, Store
from vectrine.sources import chat, evaluation, files, history, mail, vectors
from vectrine.storage import fresh, written

# Passages, manifests and vectors.


@query("SELECT doc_id::VARCHAR AS id, lang, md5(text) AS mark FROM documents WHERE trim(text) <> ''")
def passages_written_and_read(spark, sf_dir):
    path = fresh(spark, "passages")
    rows = passages.from_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id")
    passages.write_json_lines(rows.select("id", "text", "metadata"), path)
    return passages.read_shards(spark, [path]).select(
        "id", F.try_variant_get("metadata", "$.lang", "string").alias("lang"), F.md5("text").alias("mark")
    )


@query("SELECT doc_id - 1 + 1 AS id, 'Document ' || doc_id AS text FROM documents")
def placeholder_passages(spark, sf_dir):
    rows = passages.placeholders(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")))
    return rows.select(F.col("id").cast("long").alias("id"), "text")


@query("SELECT 'graph' AS backend, 'cosine' AS metric, count(*) AS rows, true AS is_pruned FROM documents")
def manifest_written_and_read(spark, sf_dir):
    folder = fresh(spark, "manifest")
    n = table(spark, sf_dir, "documents").count()
    Manifest(metric="cosine", rows=n).write(folder, spark)
    m = Manifest.read(folder, spark)
    return spark.createDataFrame(
        [(m.backend_name, m.metric, m.rows, m.is_pruned)], "backend string, metric string, rows long, is_pruned boolean"
    )


@query(
    "SELECT vec_id::VARCHAR AS id, i AS at, round(embedding[i + 1]::DOUBLE, 6) + 0.0 AS value FROM (SELECT *, unnest(range(0, len(embedding))) AS i FROM embeddings)"
)
def vectors_from_archives(spark, sf_dir):
    held = vectors.from_archives(vectors.to_archives(_vectors(spark, sf_dir)))
    out = held.select("id", F.posexplode("embedding").alias("at", "x"))
    return out.select("id", F.col("at").cast("long").alias("at"), (F.round(F.col("x").cast("double"), 6) + 0.0).alias("value"))


@query(
    "SELECT d.doc_id AS id, d.lang, len(e.embedding)::BIGINT AS size FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id WHERE d.doc_id < (SELECT count(*) FROM embeddings)"
)
def passages_with_vectors(spark, sf_dir):
    """Passages and their vectors by id; unequal counts would be an error."""
    data = _vectors(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").join(data.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    both = passages.aligned(
        docs.select(F.col("doc_id").cast("string").alias("id"), "lang"),
        data.join(docs.select(F.col("doc_id").alias("id")), "id", "left_semi")
    )
    return both.select(F.col("id").cast("long").alias("id"), "lang", F.size("embedding").cast("long").alias("size"))


@query(
    "SELECT CASE WHEN (SELECT count(*) FROM documents WHERE doc_id = 7) = 1 THEN 'found' END AS known, 'missing' AS unknown, true AS is_same FROM (SELECT 1)"
)
def passage_by_id(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    try:
        passages.get(rows, "no such id")
        unknown = "found"
    except KeyError:
        unknown = "missing"
    return rows.where("id = '7'").select(
        F.lit("found").alias("known"),
        F.lit(unknown).alias("unknown"),
        (F.col("text") == F.lit(passages.get(rows, "7")["text"])).alias("is_same")
    )


@query(
    "SELECT doc_id, octet, (sum(octet) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - octet)::BIGINT AS \"offset\" FROM (SELECT doc_id, strlen(text) + 1 AS octet FROM documents)"
)
def byte_offsets(spark, sf_dir):
    rows = relational.byte_offsets(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return rows.select("doc_id", (F.octet_length("text") + 1).cast("long").alias("octet"), F.col("offset").cast("long").alias("offset"))


# Files, mail, history, chats.


@query("SELECT page_id, md5(html) AS mark, '.html' AS extension FROM pages")
def files_read(spark, sf_dir):
    """Pages as files of a folder, beside hidden files, files of another kind and an excluded folder."""
    path = fresh(spark, "files")
    files.write_lines(table(spark, sf_dir, "pages"), "page_id", "html", f"{path}/site")
    store = Store(spark)
    for name in (".hidden/a.txt", "site/b.bin", "node_modules/c.txt"):
        store.write(f"{path}/{name}", "not wanted")
    found = files.read(spark, [path, f"{path}-none"], [".txt"])
    mark = F.md5(F.regexp_replace("text", r"\n$", "").cast("binary"))
    return found.select(
        F.regexp_extract("file_path", r"page_id=(\d+)", 1).cast("long").alias("page_id"),
        mark.alias("mark"),
        F.lit(".html").alias("extension")
    )


@query(
    "SELECT ext AS extension, n AS files, row_number() OVER (ORDER BY ext) AS place FROM (SELECT regexp_extract(url, '[^/](\\.[^./]+)$', 1) AS ext, count(*) AS n FROM pages GROUP BY ext)"
)
def extensions_in_order(spark, sf_dir):
    rows = files.extensions_of(table(spark, sf_dir, "pages").select(chunk.extension(F.col("url")).alias("extension")))
    # the order that the listing came in
    return rows.withColumn("_at", F.monotonically_increasing_id()).withColumn(
        "place", F.row_number().over(Window.orderBy("_at")).cast("long")
    ).drop("_at")


@query("SELECT page_id, url LIKE '%/.%' AS hidden, contains(url, '/build/') AS excluded FROM pages")
def path_predicates(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", files.is_hidden(url).alias("hidden"), files.in_folder(url, ("build",)).alias("excluded")
    )


@query(
    "SELECT conv_id || '-' || turn || '.emlx' AS file, role || '@example.org' AS sender, 'Turn ' || turn AS subject, md5(trim(text, ' ')) AS mark FROM conversations WHERE trim(text) <> ''"
)
def mail_read(spark, sf_dir):
    head = F.concat(
        F.lit("From: "),
        F.col("role"),
        F.lit("@example.org\nTo: all@example.org\nSubject: Turn "),
        F.col("turn").cast("string"),
        F.lit("\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n")
    )
    raw = F.concat(F.lit("123\n"), head, F.col("text")).cast("binary")
    name = F.concat_ws("-", F.col("conv_id").cast("string"), F.concat(F.col("turn").cast("string"), F.lit(".emlx")))
    rows = mail.parsed(table(spark, sf_dir, "conversations").where("trim(text) <> ''").select(name.alias("file"), raw.alias("content")))
    return rows.select("file", "sender", "subject", F.md5(F.trim("body").cast("binary")).alias("mark"))


@query(
    "SELECT conv_id, count(*) AS messages, string_agg('Turn ' || turn, ',' ORDER BY turn) AS subjects FROM conversations WHERE trim(text) <> '' GROUP BY conv_id"
)
def mailbox_read(spark, sf_dir):
    line = F.concat(
        F.lit("From x\nSubject: Turn "),
        F.col("turn").cast("string"),
        F.lit("\nContent-Type: text/plain; charset=utf-8\n\n"),
        F.regexp_replace("text", r"\n+", " "),
        F.lit("\n\n")
    )
    held = table(spark, sf_dir, "conversations").where("trim(text) <> ''").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("m")
    )
    raw = F.array_join(F.transform("m", lambda m: m["line"]), "").cast("binary")
    rows = mail.parsed(held.select(F.col("conv_id").cast("string").alias("file"), raw.alias("content")), "mbox")
    turn = F.regexp_extract("subject", r"(\d+)", 1).cast("long")
    subjects = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(turn.alias("t"), "subject"))), lambda s: s["subject"]), ",")
    return rows.groupBy(F.col("file").cast("long").alias("conv_id")).agg(F.count(F.lit(1)).alias("messages"), subjects.alias("subjects"))


@query(
    "SELECT conv_id, turn, '[From]: ' || role || chr(10) || '[To]: all' || chr(10) || '[Subject]: ' || turn || chr(10) || '[Date]: today' || chr(10) || '[EMAIL BODY Start]:' || chr(10) || text AS document FROM conversations"
)
def mailbox_template(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select(
        "conv_id", "turn", tx.mailbox_document(F.col("role"), F.lit("all"), F.col("turn"), F.lit("today"), F.col("text")).alias("document")
    )


@query(
    "SELECT conv_id, turn, '[File]: ' || conv_id || chr(10) || '[From]: ' || role || chr(10) || '[To]: all' || chr(10) || '[Subject]: ' || turn || chr(10) || '[Date]: today' || chr(10) || '[EMAIL BODY Start]:' || chr(10) || text AS document FROM conversations"
)
def mail_template(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select(
        "conv_id",
        "turn",
        tx.mail_document(F.col("conv_id"), F.col("role"), F.lit("all"), F.col("turn"), F.lit("today"), F.col("text")).alias("document")
    )


@query(
    "SELECT conv_id::VARCHAR AS contact, turn AS pos, role = 'user' AS own, text, n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_at, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE turn >= 0"
)
def chat_read(spark, sf_dir):
    """Conversations as one JSON array a contact; a message's place is its turn, counted from the first."""
    held = table(spark, sf_dir, "conversations")
    one = F.struct(
        "turn", F.col("text").alias("message"), (F.col("turn") * 60).alias("createTime"), (F.col("role") == "user").alias("isSentFromSelf")
    )
    grouped = held.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(one)).alias("m"), F.min("turn").alias("first"), F.count(F.lit(1)).alias("n")
    )
    rows = chat.parsed(grouped.select(F.col("conv_id").cast("string").alias("contact"), F.to_json("m").alias("value")))
    firsts = grouped.select(F.col("conv_id").cast("string").alias("contact"), "first", "n")
    return rows.join(firsts, "contact").select("contact", (F.col("pos") + F.col("first")).alias("pos"), "own", "text", "n")


@query("SELECT conv_id::VARCHAR AS contact, turn AS pos, md5(text) AS mark FROM conversations")
def chat_exported(spark, sf_dir):
    """Exported as JSON, a folder for each contact."""
    path = fresh(spark, "chats")
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("contact"),
        F.col("turn").alias("pos"),
        F.lit(0).cast("long").alias("t"),
        F.lit(True).alias("own"),
        "text"
    )
    chat.export_json(rows, path)
    return spark.read.schema("contact string, pos long, text string, user string").json(path).select(
        "contact", "pos", F.md5("text").alias("mark")
    )


@query("SELECT conv_id, '[Contact] means the message is from: ' || conv_id || chr(10) || text AS chunk, turn FROM conversations")
def chat_chunks(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.col("conv_id").cast("string").alias("contact"), F.col("text").alias("chunk")
    )
    return chat.with_contact(rows).select("conv_id", "chunk", "turn")


@query("SELECT page_id, url || ' | ' || page_id AS quoted FROM pages")
def chat_quotes(spark, sf_dir):
    """Cards of XML: a title, and what they quote."""
    xml = F.concat(
        F.lit("<msg><title>"),
        F.replace("url", F.lit("&"), F.lit("&amp;")),
        F.lit("</title><refermsg><content>"),
        F.col("page_id").cast("string"),
        F.lit("</content></refermsg></msg>")
    )
    return table(spark, sf_dir, "pages").withColumn("x", xml).select("page_id", chat.quoted("x").alias("quoted"))


@query(
    "SELECT url, '[Title]: ' || url || chr(10) || '[URL of the page]: ' || url || chr(10) || '[Last visited time]: 2024-01-01 00:00:' || lpad((page_id % 60)::VARCHAR, 2, '0') || chr(10) || '[Visit times]: ' || length(html) || chr(10) || '[Typed times]: 0' AS text FROM pages"
)
def history_documents(spark, sf_dir):
    micros = F.lit(13_348_540_800_000_000) + F.pmod("page_id", F.lit(60)) * 1_000_000
    rows = table(spark, sf_dir, "pages").select(
        micros.alias("last_visit_time"),
        "url",
        F.col("url").alias("title"),
        F.length("html").alias("visit_count"),
        F.lit(0).alias("typed_count"),
        F.lit(0).alias("hidden")
    )
    return history.documents(rows, with_url=True).select("url", "text")


# Evaluation.


@query("SELECT item_id AS qid, text AS query FROM benchmark WHERE trim(text) <> ''")
def query_set(spark, sf_dir):
    path = fresh(spark, "queries")
    table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query")).write.json(path)
    return evaluation.queries(spark, path)


_TOP = _ranked("list_dot_product(q.e, v.e)", 10, _V)


@query(f"SELECT qid, rank, id FROM ({_TOP}) WHERE rank <= 3")
def golden_set(spark, sf_dir):
    """Golden ids of all queries, written as lines of JSON and read back, the first three of ten."""
    path = fresh(spark, "golden")
    data = _vectors(spark, sf_dir)
    near = knn.exact_top_k(data, _asked(data), 10).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("m"))
    near.select("qid", F.transform("m", lambda m: m["id"]).alias("indices")).write.json(path)
    return evaluation.golden(spark, path, 3)


@query("SELECT vec_id AS qid, 1.0::DOUBLE AS recall FROM embeddings WHERE vec_id % 20 = 0")
def recall_by_text(spark, sf_dir):
    """Exact search finds all golden texts, those of copies included."""
    data = _vectors(spark, sf_dir)
    docs = data.select("id", F.concat(F.lit("text of "), F.col("id").cast("string")).alias("text"))
    near = passages.lookup(knn.exact_top_k(data, _asked(data), 3), docs)
    return evaluation.recall_by_text(
        near.select("qid", "text"), evaluation.golden_texts(near.select("qid", "rank", "id"), docs).select("qid", "text")
    )


@query("SELECT event_type, max(value) AS peak, max(value) - arg_min(value, ts) AS delta FROM events GROUP BY event_type")
def memory_peaks(spark, sf_dir):
    return evaluate.memory(table(spark, sf_dir, "events"), "event_type", "value", "ts")


@query(
    "SELECT i AS id, 'This is document ' || i || ' about topic ' || (i % 10) || '.' AS head, i % 10 AS topic FROM (SELECT unnest(range(0, (SELECT count(*) FROM documents))) AS i)"
)
def synthetic_corpus(spark, sf_dir):
    rows = evaluation.corpus(spark, table(spark, sf_dir, "documents").count())
    return rows.select("id", F.concat(F.substring_index("text", ".", 1), F.lit(".")).alias("head"), "topic")


# Embedding and recomputation.

_TEXTS = _HASHED + ", u AS (SELECT doc_id, \"at\", (v / n)::FLOAT::DOUBLE AS x FROM b JOIN n USING (doc_id) WHERE v <> 0)"


@query(
    _TEXTS + ", q AS (SELECT \"at\", x FROM u WHERE doc_id = 0) SELECT k AS id, coalesce((SELECT -round(sum(u.x * q.x), 6) FROM u JOIN q USING (\"at\") WHERE u.doc_id = k), CASE WHEN k IN (SELECT doc_id FROM documents) THEN 0.0 ELSE 1e9 END) + 0.0 AS distance FROM (SELECT doc_id + 5 AS k FROM documents)"
)
def recomputed_distances(spark, sf_dir):
    """Ids moved by five: the last ones have no passage, and get the sentinel."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    q = [float(x) for x in embed.compute([passages.get(docs, 0)["text"]])[0]]
    rows = embed.recomputed_distances(docs.select((F.col("id") + 5).alias("id")), docs, q)
    return rows.select(
        "id",
        (F.when(F.col("distance") == vector.MISSING_DISTANCE, F.col("distance")).otherwise(F.round("distance", 6)) + 0.0).alias("distance")
    )


@query(
    "SELECT doc_id + 5 AS id, doc_id + 5 IN (SELECT doc_id FROM documents) AS is_found, CASE WHEN doc_id + 5 IN (SELECT doc_id FROM documents) THEN 1.0 ELSE 0.0 END::DOUBLE AS length FROM documents"
)
def recomputed_vectors(spark, sf_dir):
    """Vectors of ids on demand; those of ids without a passage are zeros."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    rows = embed.recomputed(docs.select((F.col("id") + 5).alias("id")), docs, 64)
    return rows.select("id", "is_found", F.round(vector.norm("embedding"), 5).alias("length"))


@query(
    "SELECT label, i AS at, round(coalesce(avg(embedding[i + 1]::DOUBLE) FILTER (vec_id % 3 <> 0), 0), 6) + 0.0 AS value FROM (SELECT vec_id, label, embedding, unnest(range(0, len(embedding))) AS i FROM embeddings) GROUP BY label, i"
)
def masked_mean_pool(spark, sf_dir):
    tokens = _vectors(spark, sf_dir).withColumn("mask", (F.col("id") % 3 != 0).cast("int"))
    return embed.mean_pool(tokens, "label", "embedding", "mask").select("label", "at", (F.round("value", 6) + 0.0).alias("value"))


@query(
    "SELECT * FROM (VALUES ('text-embedding-3-small', 'openai', 'cosine'), ('facebook/contriever', 'sentence-transformers', 'mips'), ('nomic-embed-text', 'ollama', 'mips')) t(model, mode, metric)"
)
def default_metrics(spark, sf_dir):
    models = [("text-embedding-3-small", "openai"), ("facebook/contriever", "sentence-transformers"), ("nomic-embed-text", "ollama")]
    return spark.createDataFrame(
        [(m, mode, vector.default_metric(m, mode)) for m, mode in models], "model string, mode string, metric string"
    )


# Indexes.


def _index(spark, sf_dir, backend="flat", **options):
    folder = fresh(spark, "index")
    rows = table(spark, sf_dir, "benchmark").select("item_id", "text", (F.col("item_id") % 3).alias("shelf"))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        builder = index.Builder(spark, backend, is_recompute=False, **options).add_documents(rows, "item_id")
    return folder, builder, builder.build(folder), rows


_BENCH = """
WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[^ \\t\\n\\r\\f\\v]+')) AS token FROM benchmark),
b AS (SELECT item_id, ('0x' || substr(md5(token), 1, 8))::BIGINT % 64 AS at, sum(CASE WHEN ('0x' || substr(md5(token), 9, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END) AS v FROM t GROUP BY ALL),
n AS (SELECT item_id, sqrt(sum(v * v)::DOUBLE) AS n FROM b GROUP BY item_id),
u AS (SELECT item_id, "at", (v / n)::FLOAT::DOUBLE AS x FROM b JOIN n USING (item_id)),
s AS (SELECT q.item_id AS qid, u.item_id AS id, round(sum(q.x * u.x), 6) + 0.0 AS score FROM u q JOIN u USING ("at") GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s)
"""


def _found(hits):
    return hits.select(F.col("qid"), F.col("id").cast("long").alias("id"), "rank")


@query(_BENCH + "SELECT qid, id, rank FROM r WHERE rank <= 3")
def index_search(spark, sf_dir):
    """Build from texts, then search all of them: embedding, exact search, passages joined."""
    folder, _, _, rows = _index(spark, sf_dir)
    held = rows.orderBy("item_id").collect()
    hits = index.Searcher(spark, folder).search([r["text"] for r in held], 3)
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(held)], "qid long, item long")
    return _found(hits.join(names, "qid").withColumn("qid", F.col("item")))


@query(_BENCH + "SELECT qid, id, rank FROM r WHERE rank <= 5 AND id % 3 = 1")
def index_search_filtered(spark, sf_dir):
    """Five hits of each query, then those of them that meet the filter."""
    folder, _, _, rows = _index(spark, sf_dir)
    held = rows.orderBy("item_id").collect()
    hits = index.Searcher(spark, folder).search([r["text"] for r in held], 5, filters={"shelf": {"==": 1}})
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(held)], "qid long, item long")
    return _found(hits.join(names, "qid").withColumn("qid", F.col("item")))


@query(
    "SELECT b AS backend, count(*) AS passages, count(*) AS hits, true AS has_vectors, 'refused' AS second_build FROM benchmark, (VALUES ('disk'), ('flat'), ('graph')) t(b) GROUP BY b"
)
def index_backends(spark, sf_dir):
    """Each backend: built, searched with every text, whose own passage comes first; a second build without force is refused."""
    out = []
    for name in index.discover():
        folder, builder, m, rows = _index(spark, sf_dir, name)
        texts = [r["text"] for r in rows.orderBy("item_id").collect()]
        hits = index.Searcher(spark, folder).search(texts, 1).where(F.col("text").isin(texts)).count()
        try:
            builder.build(folder)
            again = "built"
        except FileExistsError:
            again = "refused"
        out.append((name, m.rows, hits, Store(spark).exists(f"{folder}/embeddings"), again))
    return spark.createDataFrame(out, "backend string, passages long, hits long, has_vectors boolean, second_build string")


@query("SELECT count(*) AS rows, true AS is_precomputed, 64::BIGINT AS dimensions, 'refused' AS unequal FROM embeddings")
def index_from_vectors(spark, sf_dir):
    """Build from vectors alone; texts that don't match them in number are refused."""
    folder, data = fresh(spark, "index"), _vectors(spark, sf_dir).select("id", "embedding")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        builder = index.Builder(spark, "flat", is_recompute=False)
    m = builder.build_from_embeddings(folder, data)
    try:
        builder.build_from_embeddings(folder, data, data.where("id > 0").select("id", F.lit("x").alias("text")), force=True)
        unequal = "built"
    except ValueError:
        unequal = "refused"
    return spark.createDataFrame(
        [(m.rows, m.built_from_precomputed_embeddings, m.dimensions, unequal)],
        "rows long, is_precomputed boolean, dimensions long, unequal string"
    )


@query(
    "SELECT * FROM (VALUES (true, true, true), (true, false, false), (false, true, false), (false, false, false)) t(recompute, compact, pruned)"
)
def index_flags(spark, sf_dir):
    """What is kept of the flags: without recomputation no index is compact."""
    out = []
    for recompute in (True, False):
        for compact in (True, False):
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                m = index.Builder(spark, is_recompute=recompute, is_compact=compact).manifest
            out.append((recompute, compact, m.is_pruned))
    return spark.createDataFrame(out, "recompute boolean, compact boolean, pruned boolean")


@query("SELECT shard, sum(n)::BIGINT AS nodes FROM (SELECT 0 AS shard, 1 AS n FROM embeddings) GROUP BY shard")
def graph_partitions(spark, sf_dir):
    data = _vectors(spark, sf_dir)
    info = graph.partitions(written(graph.build(data, "l2", 8, 32, rows=data.count()), "graph"))
    return info.select(F.lit(0).alias("shard"), "nodes").groupBy("shard").agg(F.sum("nodes").alias("nodes"))


@query("SELECT vec_id AS id, 16::BIGINT AS parts, true AS is_bounded FROM embeddings")
def product_codes(spark, sf_dir):
    """Codes of all vectors; decoded they lie as far off as their error says, and closer than the length."""
    data = _vectors(spark, sf_dir)
    rows = pq.encode(data, pq.train(data))
    return rows.select(
        "id", F.size("codes").cast("long").alias("parts"), ((F.col("error") >= 0) & (F.col("error") < F.col("length"))).alias("is_bounded")
    )


# Messages and chunks.

_CARRY = """
WITH RECURSIVE m AS (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, length(text) AS n FROM conversations WHERE trim(text) <> ''
), f AS (
  SELECT conv_id, turn, r, n, n AS held, 1 AS members, 0::BIGINT AS group_no, NULL::BIGINT AS carried_turn FROM m WHERE r = 1
  UNION ALL
  SELECT m.conv_id, m.turn, m.r, m.n,
    CASE WHEN f.held + m.n <= 400 THEN f.held + m.n WHEN f.members > 1 THEN f.n + m.n ELSE m.n END,
    CASE WHEN f.held + m.n <= 400 THEN f.members + 1 WHEN f.members > 1 THEN 2 ELSE 1 END,
    f.group_no + CASE WHEN f.held + m.n > 400 THEN 1 ELSE 0 END,
    CASE WHEN f.held + m.n > 400 AND f.members > 1 THEN f.turn END
  FROM f JOIN m ON m.conv_id = f.conv_id AND m.r = f.r + 1
)
SELECT conv_id AS conv, group_no, turn AS pos, false AS carried FROM f
UNION ALL SELECT conv_id, group_no, carried_turn, true FROM f WHERE carried_turn IS NOT NULL
"""


@query(_CARRY)
def group_overlap(spark, sf_dir):
    held = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("conv"), F.col("turn").alias("pos"), F.lit(0).cast("long").alias("t"), "text"
    )
    return messages.group_messages(held, 400, -1, 1).select("conv", "group_no", "pos", "carried")


@query(
    "SELECT doc_id, k AS chunk_no, 'def f' || k || '():' || chr(10) || '    return \"' || source || '\"  # ' || doc_id AS chunk FROM documents, range(3) r(k)"
)
def code_chunks(spark, sf_dir):
    """Python sources of three functions, each a chunk of its own."""
    parts = [
        F.concat(
            F.lit(f'def f{k}():\n    return "'), F.col("source"), F.lit('"  # '), F.col("doc_id").cast("string"), F.lit("\n\n\n")
        ) for k in range(3)
    ]
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(*parts).alias("text"), F.lit("a.py").alias("file_path"))
    return chunk.chunk_documents(docs, code_profile=(40, 0)).select("doc_id", "chunk_no", "chunk")


@query("SELECT doc_id, k AS chunk_no, 'int f' || k || '() { return ' || doc_id || '; } // {' AS chunk FROM documents, range(3) r(k)")
def code_chunks_java(spark, sf_dir):
    parts = [F.concat(F.lit(f"int f{k}() {{ return "), F.col("doc_id").cast("string"), F.lit("; } // {\n")) for k in range(3)]
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(*parts).alias("text"), F.lit("A.java").alias("file_path"))
    return chunk.chunk_documents(docs, code_profile=(35, 0)).select("doc_id", "chunk_no", "chunk")


@query(
    "SELECT size, overlap, CASE WHEN size > 0 THEN size ELSE 256 END AS used, least(greatest(0, overlap), CASE WHEN size > 0 THEN size ELSE 256 END - 1) AS carried FROM (VALUES (256, 128), (0, 10), (10, 10), (10, 99), (5, -1)) t(size, overlap)"
)
def chunk_sizes(spark, sf_dir):
    rows = [(s, o, *chunk.checked(s, o)) for s, o in ((256, 128), (0, 10), (10, 10), (10, 99), (5, -1))]
    return spark.createDataFrame(rows, "size int, overlap int, used int, carried int")
