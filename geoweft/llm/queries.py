"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweft.llm import chat, decontaminate, exact_dedup, language_id, lexical, lines, merkle, packing, paragraphs, secrets, set_join, sharding, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(packing.pack(table(spark, sf_dir, "documents"), tokenizer_path()))


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list stands for a block list: the canonical URLs of the pages whose id is divisible by 100."""
    pages = table(spark, sf_dir, "pages")
    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, RULES))} AS r(host, path, verdict)")
    url = F.col("url")
    listed = pages.filter("page_id % 100 = 0").select(url_filter.canonical(url_filter.host_of(url), url_filter.path_of(url)).alias("key"))
    return url_filter.filter_urls(pages, rules, listed)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.item_digests(decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=decontaminate.SLOP))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_passages(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shard_by_bytes(table(spark, sf_dir, "documents"))
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.train_and_identify(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{said}'), (-1L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.digests(chat.format_turns(turns))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.jaccard_components(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_common_lines(table(spark, sf_dir, "documents"), texts=False).drop("text")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verifies, where 2 divides the id's checksum, a text without its line ends."""
    touched = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.col("text").contains("\n")
    fields = {f: F.col(f) for f in merkle.FIELDS}
    altered = merkle.leaf_digest((fields | {"text": F.replace("text", F.lit("\n"), F.lit(""))}).values())
    claimed = F.when(touched, altered).otherwise(merkle.leaf_digest(fields.values()))
    return merkle.proofs(merkle.build(table(spark, sf_dir, "documents"), claimed=claimed))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in queries()}


_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _merkle_sql() -> str:
    """The trees, level by level until one node is left; then each row's path up through both, folded on the way."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    others = "string_agg(digest, '' ORDER BY idx)"
    tree = lambda name, start: f"{name}(grp, lvl, idx, digest) AS ({start} UNION ALL SELECT grp, lvl + 1, idx // 3, sha256({others}) FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM {name}) WHERE n > 1 GROUP BY grp, lvl, idx // 3)"
    leaf = lambda text: "sha256(" + " || ".join(field(c) if c != "text" else field(text) for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"
    return f"""
        WITH RECURSIVE bits(n, c, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
        t AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
        b AS (SELECT *, list_transform(range(1, strlen(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT)) AS b FROM documents),
        d AS (SELECT doc_id, coalesce('s' || source, '') AS grp, {leaf("text")} AS leaf,
                     CASE WHEN xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS claimed FROM b, t),
        l AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM d),
        {tree("low", "SELECT grp, 0, idx, leaf FROM l")},
        sub AS (SELECT grp, arg_max(digest, lvl) AS subroot FROM low GROUP BY grp),
        ranked AS (SELECT grp, subroot, row_number() OVER (ORDER BY encode(grp)) - 1 AS idx FROM sub),
        {tree("high", "SELECT 'top', 0, idx, subroot FROM ranked")},
        root AS (SELECT arg_max(digest, lvl) AS root FROM high),
        node AS (SELECT 0 AS part, * FROM low UNION ALL SELECT 1, * FROM high),
        beside AS (SELECT n.part, n.grp, n.lvl, n.idx, coalesce(string_agg(s.digest, '' ORDER BY s.idx) FILTER (s.idx < n.idx), '') AS before, coalesce(string_agg(s.digest, '' ORDER BY s.idx) FILTER (s.idx > n.idx), '') AS after
                   FROM node n JOIN node s ON s.part = n.part AND s.grp = n.grp AND s.lvl = n.lvl AND s.idx // 3 = n.idx // 3 GROUP BY ALL),
        top AS (SELECT part, grp, max(lvl) AS lvl FROM node GROUP BY part, grp),
        path(doc_id, own, grp, part, lvl, idx, place, folded, proof) AS (
            SELECT doc_id, l.idx, l.grp, 0, CAST(0 AS BIGINT), l.idx, ranked.idx, claimed, '' FROM l JOIN ranked USING (grp)
            UNION ALL
            SELECT doc_id, own, p.grp, CASE WHEN p.lvl < top.lvl THEN p.part ELSE 1 END, CASE WHEN p.lvl < top.lvl THEN p.lvl + 1 ELSE 0 END, CASE WHEN p.lvl < top.lvl THEN p.idx // 3 ELSE place END, place,
                   CASE WHEN p.lvl < top.lvl THEN sha256(before || folded || after) ELSE folded END, CASE WHEN p.lvl < top.lvl THEN proof || before || after ELSE proof END
            FROM path p JOIN top ON top.part = p.part AND top.grp = CASE WHEN p.part = 0 THEN p.grp ELSE 'top' END JOIN beside b ON b.part = p.part AND b.grp = top.grp AND b.lvl = p.lvl AND b.idx = p.idx
            WHERE p.lvl < top.lvl OR p.part = 0),
        done AS (SELECT path.* FROM path, (SELECT lvl FROM top WHERE part = 1) z WHERE path.part = 1 AND path.lvl = z.lvl)
        SELECT l.doc_id, l.leaf, sub.subroot, root.root, sha256(done.proof) AS proof_sha256, done.folded AS folded_root, done.folded = root.root AS verified
        FROM l JOIN sub USING (grp) JOIN done ON done.grp = l.grp AND done.own = l.idx, root"""


SQL: dict[str, str] = {
    "op11_line_dedup": rf"""
        WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        x AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM l),
        k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), {_LOWER}) AS key FROM x),
        c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (c.key IS NULL), '')) AS kept_sha256
        FROM k LEFT JOIN c ON c.key = k.key GROUP BY doc_id""",
    "op12_merkle_manifest": _merkle_sql(),
    "op13_ranked_search": rf"""
        WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, {_LOWER}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents WHERE text IS NOT NULL),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, {_LOWER}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL),
        p AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL), n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY doc_id),
        s AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
        r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN n USING (doc_id), s GROUP BY item_id, doc_id)
        SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 10""",
    "op2_url_filter": r"""
        WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS t FROM pages),
        p AS (SELECT page_id, translate(regexp_extract(t, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(t, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        r(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+$', '') END AS key FROM p),
        l AS (SELECT DISTINCT key FROM c WHERE page_id % 100 = 0 AND key IS NOT NULL),
        m AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v FROM p, r
              WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
        SELECT c.page_id, host, path, m.rule, coalesce(m.v, CASE WHEN l.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, l.key IS NOT NULL AS listed
        FROM c LEFT JOIN m ON m.page_id = c.page_id LEFT JOIN l ON l.key = c.key""",
    "op5_sharding": r"""
        WITH RECURSIVE bits(n, c, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
        t AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
        h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        b AS (SELECT doc_id, list_transform(range(0, strlen(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS b, strlen(h) // 2 AS n FROM h),
        z AS (SELECT doc_id, n + 8 AS size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32 FROM b, t),
        p AS (SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size) AS upto, sum(size) OVER () AS total FROM z),
        s AS (SELECT doc_id, size, text_crc32, CAST(least(23, ((2 * (upto - size) + size) * 24) // (2 * total)) AS INT) AS shard FROM p)
        SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM s""",
    "op8_chat_format": r"""
        WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
        f AS (SELECT *, replace(replace(replace(replace(replace(text, '\', '\\'), '</s>', '<\/s>'), '<s>', '<\s>'), '[/INST]', '[\/INST]'), '[INST]', '[\INST]') AS e FROM a)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
               CAST(sum(size) AS BIGINT) AS formatted_chars, count(*) FILTER (role = 'assistant') AS n_examples,
               CAST(coalesce(sum(upto - size) FILTER (role = 'assistant'), 0) AS BIGINT) AS context_chars
        FROM (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto
              FROM (SELECT *, length('<s>[INST]  [/INST]</s>') + length(role) + length(e) AS size FROM f)) GROUP BY conv_id""",
    "op3_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bw AS (SELECT DISTINCT item, least(len(w), 13) AS k, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS g
               FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
        dw AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
               FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
        hit AS (SELECT doc_id, item, k, i FROM dw JOIN bw USING (k, g)),
        pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
        its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id),
        dp AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS t FROM d),
        freq AS (SELECT t, count(*) AS n FROM dp GROUP BY t),
        ws AS (SELECT item, k, string_split(g, ' ') AS g FROM bw),
        wt AS (SELECT item, k, g, arg_min(t, coalesce(n, 0)) AS t FROM (SELECT *, unnest(g) AS t FROM ws) LEFT JOIN freq USING (t) GROUP BY item, k, g),
        near AS (SELECT doc_id, item, k + 3 AS r, g, w, p FROM dp JOIN wt USING (t) WHERE list_has_all(w[greatest(1, p - k - 2) : p + k + 2], g)),
        st AS (SELECT *, unnest(range(greatest(1, p - r + 1), greatest(1, least(p, len(w) - r + 1)) + 1)) AS i FROM near),
        prox AS (SELECT doc_id, count(DISTINCT item) AS n_near FROM st WHERE list_has_all(w[i : i + r - 1], g) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0) AS n_near
        FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN prox USING (doc_id)""",
    "op9_jaccard_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        link AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
        r(x, y) AS (SELECT x, y FROM link UNION SELECT r.x, link.y FROM r JOIN link ON r.y = link.x),
        m AS (SELECT x, min(y) AS y FROM r GROUP BY x), k AS (SELECT x, count(*) AS n_links FROM link GROUP BY x)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id, coalesce(k.n_links, 0) AS n_links
        FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.x = d.doc_id LEFT JOIN k ON k.x = d.doc_id""",
    "op10_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept, sha256(norm) AS text_sha256
        FROM n""",
}
