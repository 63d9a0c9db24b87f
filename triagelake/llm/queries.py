"""One query per operator, on the whole of its table, and its checking SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm import centroids, chat, decontaminate, embed_dedup, ngram_join, packing, quality, runs, secrets, shard, suffix, urls, warc
from triagelake.operators.rows import settle
from triagelake.session import checkpoint, new_dir

SHARDS = 40
TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_decontamination(spark, folder):
    """Every place of a benchmark item in a document."""
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op2_sharding(spark, folder):
    """Documents in 40 shards by the law ``key``, read from the written files."""
    path = new_dir(spark, "shards")
    documents = table(spark, folder, "documents").select("doc_id", "text")
    shard.write_shards(documents, path, SHARDS, "doc_id", "text")
    return shard.read_shards(documents, path).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + shard.ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.col("grown_shard").cast("int").alias("grown_shard"),
    )


def op3_url_filters(spark, folder):
    """A verdict for every page's URL."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    return urls.judge(pages).select("page_id", "host", "path", "rule", "verdict", "pattern")


def op4_ngram_join(spark, folder):
    """Set size and component of every document at a Jaccard of 0.8."""
    return ngram_join.join(table(spark, folder, "documents"))


def op5_packing(spark, folder):
    """The sequence and offset of every piece of every document."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    cut = packing.pieces(documents, public_tokenizers.path(TOKENIZER))
    # The ids stay behind; places need lengths alone.
    light = checkpoint(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return packing.pack(light, ["doc_id", "piece"])


def op6_secrets(spark, folder):
    """Counts and places of the secrets of every document."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    found = secrets.detect(documents)
    base = F.filter("spans", lambda s: s["rank"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.written(base), 256).alias("base_sha256"),
        secrets.written(F.col("spans")).alias("spans"),
    )


def op7_suffix_dedup(spark, folder):
    """What is left of every document without strings of 100 bytes seen before."""
    return suffix.dedup(table(spark, folder, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op8_embedding_dedup(spark, folder):
    """Links, component and keeper of every vector at a cosine of 0.9."""
    return embed_dedup.dedup(table(spark, folder, "embeddings"))


def op9_chat_formatting(spark, folder):
    """Every maximal conversation, rendered."""
    return chat.render(table(spark, folder, "conversations"))


def op10_quality(spark, folder):
    """Quality score of every document."""
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    weights = quality.train(documents, labels.where(~quality.held_out()))
    scored = quality.score(documents.select("doc_id", "text"), weights, keep=("doc_id",))
    return scored.select(
        "doc_id", quality.held_out().alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op11_centroid_clusters(spark, folder):
    """Cluster, distance and inertia of every vector after ten rounds with eight centroids."""
    found = centroids.fit(table(spark, folder, "embeddings"), 8, 10, seed=3, key="vec_id", vector="embedding")
    sums = found.members.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x"))
    by_cluster = {r.cluster: int(r.x) for r in sums.collect()}  # one row per centroid
    long = lambda x: F.lit(str(x)).try_cast("long")
    each = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1) if values else F.lit(None)
    return found.members.select(
        F.col("id").alias("vec_id"), "cluster", "distance",
        each([long(by_cluster.get(c, 0)) for c in range(len(found.centroids))]).cast("long").alias("cluster_inertia"),
        long(sum(by_cluster.values())).alias("inertia"),
        each([F.lit(d) for d in found.digests()]).cast("string").alias("centroid_sha256"),
    )


def op12_warc(spark, folder):
    """Every page's record, read back from the archives written."""
    path = new_dir(spark, "warc")
    warc.write(table(spark, folder, "pages"), path, key="page_id", url="url", payload="html")
    number = lambda c: F.regexp_extract(c, r":(-?[0-9]+)$", 1).try_cast("long")
    return warc.records(spark, path).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        number("refers_to").alias("refers_to"),
    )


def repeating(documents: DataFrame) -> DataFrame:
    """``doc_id, text``; every tenth text, by crc32 of its id, gets a periodic end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    df = settle(documents.select("doc_id", "text"), g=F.floor(h / 10), w=F.when(h % 10 == 0, words))
    n = F.size("w")
    df = settle(df, a=F.when(n > 0, F.col("g") % n))
    df = settle(df, p=1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i >= F.col("a"), F.col("a") + (i - F.col("a")) % F.col("p")).otherwise(i)
    told = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("w", place(i).cast("int")))
    return df.select("doc_id", F.when(n > 0, F.array_join(told, " ")).otherwise(F.col("text")).alias("text"))


def op13_period_runs(spark, folder):
    """Counts and digests of the periodic runs of every document."""
    found = runs.detect(repeating(table(spark, folder, "documents")))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    by_length = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), -r["start"], -r["period"], r.alias("run")))
    best = F.array_max(by_length)["run"]
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"),
        best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_sharding": op2_sharding,
    "op3_url_filters": op3_url_filters,
    "op4_ngram_join": op4_ngram_join,
    "op5_packing": op5_packing,
    "op6_secrets": op6_secrets,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_quality": op10_quality,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_warc": op12_warc,
    "op13_period_runs": op13_period_runs,
}


def lloyd_sql(k: int = 8, rounds: int = 10, size: int = 64) -> str:
    """The clustering of ``op11_centroid_clusters``, round by round."""
    nearest = lambda n: f"""
        a{n} AS MATERIALIZED (
            SELECT vec_id, any_value(v) AS v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
                SELECT vec_id, v, c.c, list_sum(list_transform(range(1, {size + 1}), lambda i: (v[i] - m[i]) * (v[i] - m[i]))) AS d
                FROM kept, c{n} c) GROUP BY vec_id)"""  # noqa: E731
    moved = lambda n: f"""
        c{n + 1} AS MATERIALIZED (
            SELECT c.c, coalesce(m.m, c.m) AS m FROM c{n} c LEFT JOIN (
                SELECT c, list((s - (s % n + n) % n) // n ORDER BY i) AS m FROM (
                    SELECT c, i, sum(x) AS s, count(*) AS n
                    FROM (SELECT c, unnest(v) AS x, unnest(range({size})) AS i FROM a{n}) GROUP BY c, i) GROUP BY c) m
            ON m.c = c.c)"""  # noqa: E731
    steps = ",".join(nearest(n) + "," + moved(n) for n in range(rounds)) + "," + nearest(rounds)
    return f"""
        WITH kept AS MATERIALIZED (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE len(embedding) = {size}
                AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}),
        c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v AS m
            FROM kept ORDER BY sha256('3:' || vec_id) LIMIT {k}),{steps}
        SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
            CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
            sha256(array_to_string(m, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} c ON c.c = a.c"""


ORACLES = {
    "op4_ngram_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        members AS (
            SELECT DISTINCT doc_id, unnest(CASE
                WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS m
            FROM words),
        sizes AS (SELECT doc_id, count(*) AS n FROM members GROUP BY doc_id),
        shared AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM members a JOIN members b USING (m)
            WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS (
            SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
            WHERE 100 * common >= 80 * (p.n + q.n - common)),
        reached AS (SELECT doc_id AS x, doc_id AS y FROM documents
                    UNION SELECT r.x, l.y FROM reached r JOIN links l ON l.x = r.y)
        SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c.component_id
        FROM documents d LEFT JOIN sizes USING (doc_id)
        JOIN (SELECT x, min(y) AS component_id FROM reached GROUP BY x) c ON c.x = d.doc_id""",
    "op3_url_filters": r"""
        WITH split AS (
            SELECT page_id,
                CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
            FROM pages),
        parts AS (
            SELECT page_id,
                translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM split),
        ruled AS (
            SELECT *, CASE
                WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
                WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
                WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
                WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
            FROM parts),
        found AS (
            SELECT *, (SELECT max(p) FROM (VALUES ('spam-farm.'), ('free-bets.'), ('casino-win.'), ('ads-track.')) v(p)
                       WHERE starts_with(host || path, p) OR strpos(host, '.' || p) > 0) AS hit
            FROM ruled)
        SELECT page_id, host, path, rule,
            CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
                 WHEN hit IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
            CASE WHEN rule IS NULL AND hit IS NOT NULL THEN '||' || hit END AS pattern
        FROM found""",
    "op9_chat_formatting": r"""
        WITH numbered AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
            FROM conversations),
        begun AS (
            SELECT conv_id, n, max(n) OVER (PARTITION BY conv_id) AS last,
                string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '')
                    OVER (PARTITION BY conv_id ORDER BY n) AS chat
            FROM numbered),
        wholes AS (SELECT chat, n, min(conv_id) AS conv_id FROM begun WHERE n = last GROUP BY chat, n)
        SELECT conv_id, CAST(n AS BIGINT) AS n_turns, chat FROM wholes w
        WHERE NOT EXISTS (SELECT 1 FROM begun b WHERE b.n < b.last AND b.n = w.n AND b.chat = w.chat)""",
    "op11_centroid_clusters": lloyd_sql(),
    "op12_warc": """
        WITH sized AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
        firsts AS (
            SELECT *, min(page_id) OVER (PARTITION BY digest) AS f FROM sized)
        SELECT page_id, n AS payload_bytes, digest AS payload_digest,
            CASE WHEN n < 100 OR page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN n >= 100 AND page_id <> f THEN f END AS refers_to
        FROM firsts""",
    "op13_period_runs": r"""
        WITH bits AS (
            SELECT list(c ORDER BY b) AS crcs FROM (
                SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, _:
                    xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS c FROM range(256) t(b))),
        hashed AS (
            SELECT doc_id, coalesce(text, '') AS text, xor(list_reduce(
                list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                lambda c, x: xor(c >> 8, crcs[1 + (xor(c, x) & 255)])), 4294967295) AS h
            FROM documents, bits),
        split AS (
            SELECT doc_id, h, h // 10 AS g,
                list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM hashed),
        placed AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN g % len(w) END AS a FROM split),
        stepped AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM placed),
        texts AS (
            SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i:
                w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) END AS w
            FROM stepped),
        words AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM texts),
        same AS (
            SELECT x.doc_id, x.i, y.i - x.i AS q, x.i - row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS island
            FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i AND y.i - x.i <= x.n // 2),
        stretches AS (
            SELECT doc_id, q, min(i) AS s, max(i) + 1 + q AS e FROM same GROUP BY doc_id, q, island
            HAVING max(i) + 1 + q - min(i) >= greatest(12, 2 * q)),
        runs AS (SELECT doc_id, s, e, min(q) AS q FROM stretches GROUP BY doc_id, s, e),
        listed AS (
            SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS told,
                arg_max({'s': s, 'l': e - s, 'q': q}, {'l': e - s, 's': -s, 'q': -q}) AS best
            FROM runs GROUP BY doc_id),
        dropped AS (SELECT DISTINCT doc_id, unnest(range(s + q, e)) AS i FROM runs),
        kept AS (
            SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS body
            FROM words w ANTI JOIN dropped d ON d.doc_id = w.doc_id AND d.i = w.i GROUP BY w.doc_id)
        SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.q AS period,
            1000 * best.l // best.q AS exponent_milli, sha256(coalesce(told, '')) AS runs_sha256,
            sha256(coalesce(body, '')) AS collapsed_sha256
        FROM documents d LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)""",
}
