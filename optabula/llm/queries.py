"""Registered queries of the operators: whole tables in, full results out."""

from __future__ import annotations

from pyspark.sql import functions as F

from .chat import format_chats
from .common import table
from .decontaminate import contaminated
from .fill_middle import fill_in_middle, restored
from .line_runs import dedup_lines
from .lsh_forest import minhash_groups
from .ordinal import classify
from .packing import pack
from .phrases import dedup_substrings
from .quality_rules import quality_rules
from .sharding import even_tree, shard_documents
from .simhash import hex_digits, simhash_groups
from .training_order import training_order
from .vector_codes import vector_codes

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_training_order")
def op1(spark, sf_dir):
    """Every sequence of the documents, read back from the files in training order."""
    read = training_order(table(spark, sf_dir, "documents"))
    return read.select("slot", "doc_id", "piece", "n_tokens", F.xxhash64("ids").alias("ids_digest"))


@query("op2_quality_classifier")
def op2(spark, sf_dir):
    """Every document with its expected grade, the probability of the top grade and the verdict."""
    out = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.round("quality.expected_grade", 6).alias("expected_grade"),
                      F.round("quality.p_keep", 6).alias("p_keep"), "quality.kept")


@query("op3_best_fit_packing")
def op3(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


WORD = "'[^\\x20\\x09-\\x0D]+'"
BASE_MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@query("op4_chat_formatting", """
    WITH turns AS (
      SELECT conv_id, list({'turn': turn, 'role': coalesce(role, ''), 'text': coalesce(text, '')}
        ORDER BY turn, role, text) AS seq
      FROM (SELECT DISTINCT * FROM conversations) GROUP BY conv_id),
    said AS (SELECT conv_id, seq, list_transform(seq, lambda x: {'role': x.role, 'text': x.text}) AS key FROM turns),
    inner_keys AS (SELECT DISTINCT key[1:n] AS key FROM (
      SELECT key, unnest(range(1, len(key))) AS n FROM said)),
    whole AS (SELECT key, min(conv_id) AS conv_id, count(*) AS n_copies FROM said GROUP BY key)
    SELECT conv_id, CAST(len(key) AS BIGINT) AS n_turns, n_copies, list_aggregate(list_transform(key,
        lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)),
        'string_agg', '') AS text
    FROM whole w WHERE NOT EXISTS (SELECT 1 FROM inner_keys i WHERE i.key = w.key)""")
def op4(spark, sf_dir):
    return format_chats(table(spark, sf_dir, "conversations"))


@query("op5_decontamination", """
    WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')),
        '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
    iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')),
        '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
    ds AS (SELECT doc_id, p, array_to_string(w[p + 1:p + 5], ' ') AS s FROM (
      SELECT doc_id, w, unnest(range(len(w) - 4)) AS p FROM dw WHERE len(w) >= 5)),
    its AS (SELECT item_id, n, p, array_to_string(w[p + 1:p + 5], ' ') AS s FROM (
      SELECT item_id, w, len(w) AS n, unnest(range(len(w) - 4)) AS p FROM iw WHERE len(w) >= 5)),
    met AS (SELECT doc_id, item_id, n, m FROM (SELECT DISTINCT doc_id, ds.p, item_id, n, len(w) AS m
        FROM ds JOIN its USING (s) JOIN dw USING (doc_id)) GROUP BY doc_id, item_id, n, m
      HAVING count(*) >= 0.8 / 1.8 * (least(m, n) + n - 8) - 1e-6),
    st AS (SELECT doc_id, item_id, n, unnest(range(greatest(1, m - n + 1))) AS start FROM met),
    win AS (SELECT doc_id, item_id, start, n, s, count(*) AS c
      FROM st JOIN ds USING (doc_id) WHERE p BETWEEN start AND start + n - 5 GROUP BY ALL),
    ic AS (SELECT item_id, s, count(*) AS ci FROM its GROUP BY ALL),
    sim AS (SELECT doc_id, item_id, start, sum(least(c, coalesce(ci, 0))) / (sum(c) + any_value(n) - 4
        - sum(least(c, coalesce(ci, 0)))) AS similarity
      FROM win LEFT JOIN ic USING (item_id, s) GROUP BY ALL)
    SELECT doc_id, item_id, CAST(arg_min(start, (-similarity, start)) AS INTEGER) AS start,
      round(max(similarity), 9) AS similarity
    FROM sim WHERE similarity >= 0.8 GROUP BY ALL""")
def op5(spark, sf_dir):
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", F.round("similarity", 9).alias("similarity"))


@query("op6_line_dedup", """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
        list_filter(string_split(coalesce(text, ''), chr(10)),
          lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
    ln AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d),
    gone AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (
        PARTITION BY l[i] ORDER BY doc_id, i) AS k FROM ln) WHERE k > 1),
    kept AS (SELECT doc_id, count(gone.i) AS n_removed,
        string_agg(CASE WHEN gone.i IS NULL THEN l[ln.i] END, chr(10) ORDER BY ln.i) AS text
      FROM ln LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, len(l) AS n_lines, coalesce(n_removed, 0) AS n_removed,
      sha256(CASE WHEN n_removed > 0 THEN coalesce(kept.text, '') ELSE d.text END) AS kept_sha256
    FROM d LEFT JOIN kept USING (doc_id)""")
def op6(spark, sf_dir):
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "line_dedup.n_lines", "line_dedup.n_removed",
                      F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def tree_sql(shards: int) -> str:
    """The descent through the tree of `shards` equal shards, level by level in joins."""
    bits = "CAST(('0x' || substr(md5(name || '/' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT)"
    draw = f"-ln(({bits} + 0.5e0) / 4503599627370496e0) / weight"
    return f"""
    t{shards} AS (SELECT s, '/region' || (s // 4) AS region,
        '/region' || (s // 4) || '/rack' || (s // 2) AS rack,
        '/region' || (s // 4) || '/rack' || (s // 2) || '/' || s AS leaf
      FROM (SELECT unnest(range({shards})) AS s)),
    r{shards} AS (SELECT doc_id, arg_min(name, {draw}) AS region
      FROM ids, (SELECT region AS name, count(*) AS weight FROM t{shards} GROUP BY ALL) GROUP BY doc_id),
    k{shards} AS (SELECT doc_id, arg_min(name, {draw}) AS rack
      FROM r{shards} JOIN (SELECT region, rack AS name, count(*) AS weight FROM t{shards} GROUP BY ALL)
        USING (region) GROUP BY doc_id),
    s{shards} AS (SELECT doc_id, arg_min(s, {draw}) AS s
      FROM k{shards} JOIN (SELECT rack, s, leaf AS name, 1 AS weight FROM t{shards}) USING (rack)
      GROUP BY doc_id)"""


@query("op7_sharding", f"""
    WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
        lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
    bytes AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
        lambda x: CAST('0x' || x AS BIGINT)) AS b FROM documents),
    sized AS (SELECT doc_id, CAST(len(b) + 1 AS BIGINT) AS size, CAST(xor(list_reduce(
        list_prepend(CAST(4294967295 AS BIGINT), b),
        lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) AS BIGINT) AS text_crc32
      FROM bytes, crc),
    ids AS (SELECT DISTINCT doc_id FROM documents), {tree_sql(8)}, {tree_sql(9)},
    placed AS (SELECT doc_id, size, text_crc32, CAST(s8.s AS INTEGER) AS shard, CAST(s9.s AS INTEGER) AS grown_shard
      FROM sized JOIN s8 USING (doc_id) JOIN s9 USING (doc_id))
    SELECT *, 'key' AS law, row_number() OVER (PARTITION BY shard
      ORDER BY (doc_id % 4096 + text_crc32) % 4096, doc_id, text_crc32, size) - 1 AS slot FROM placed""")
def op7(spark, sf_dir):
    return shard_documents(table(spark, sf_dir, "documents"), even_tree(8), even_tree(9))


@query("op8_substring_dedup", f"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents),
    win AS (SELECT doc_id, p, array_to_string(w[p:p + 49], ' ') AS s FROM (
      SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
    later AS (SELECT doc_id, p FROM (
      SELECT *, min(doc_id) OVER (PARTITION BY s) AS first FROM win) WHERE doc_id > first),
    gone AS (SELECT DISTINCT doc_id, p + o AS i FROM later, (SELECT unnest(range(50)) AS o)),
    pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
    kept AS (SELECT doc_id, count(gone.i) AS n_removed,
        string_agg(CASE WHEN gone.i IS NULL THEN w[pos.i] END, ' ' ORDER BY pos.i) AS text
      FROM pos LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed,
      sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""")
def op8(spark, sf_dir):
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def stop_words_sql() -> str:
    from .quality_rules import STOP_WORDS

    return ", ".join(f"'{w}'" for w in STOP_WORDS)


@query("op9_quality_rules", f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {WORD}) AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)),
          lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
    win AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, array_to_string(w[p:p + 4], ' ')) AS c
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) >= 5)),
    rep AS (SELECT doc_id, count(DISTINCT p + o) AS n FROM win, (SELECT unnest(range(5)) AS o)
      WHERE c > 1 GROUP BY doc_id),
    m AS (SELECT doc_id, len(w) AS n_words,
        coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
        len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(l) AS n_lines,
        len(list_filter(w, lambda x: x IN ({stop_words_sql()}))) AS stops,
        len(list_filter(l, lambda x: regexp_matches(x, '^[ \\t]*[-*\u2022]'))) AS bullets,
        len(list_filter(l, lambda x: regexp_matches(x, '([.][.][.]|\u2026)[ \\t\\r]*$'))) AS cuts
      FROM d LEFT JOIN rep USING (doc_id)),
    b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
      base_failed, NOT base_failed AND word_chars BETWEEN 2 * n_words AND 20 * n_words
        AND n_symbols <= 0.1e0 * n_words AND (n_words < 50 OR stops / n_words >= 0.02e0)
        AND n_dup_lines <= 0.5e0 * n_lines AND bullets <= 0.9e0 * n_lines AND cuts <= 0.3e0 * n_lines AS kept
    FROM b""")
def op9(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", *BASE_MEASURES, "base_failed", "kept")


@query("op10_simhash")
def op10(spark, sf_dir):
    out = simhash_groups(table(spark, sf_dir, "documents"), shingle=4, distance=4)
    return out.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def lloyd_sql(rounds: int) -> str:
    """Codebooks c0, c1 .. and assignments a0, a1 .. of parts of four components, by full scans."""
    steps = ["""
    c0 AS (SELECT * FROM (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS k,
        x1, x2, x3, x4 FROM p) WHERE k < 64)"""]
    for r in range(rounds + 1):
        steps.append(f"""
    a{r} AS (SELECT vec_id, label, part, x1, x2, x3, x4, arg_min(k, (d, k)) AS k, min(d) AS d
      FROM (SELECT p.*, c.k, (p.x1 - c.x1) * (p.x1 - c.x1) + (p.x2 - c.x2) * (p.x2 - c.x2)
          + (p.x3 - c.x3) * (p.x3 - c.x3) + (p.x4 - c.x4) * (p.x4 - c.x4) AS d
        FROM p JOIN c{r} c USING (part)) GROUP BY vec_id, label, part, x1, x2, x3, x4)""")
        if r < rounds:
            mean = ", ".join(f"(sum(x{i}) - ((sum(x{i}) % count(*)) + count(*)) % count(*)) // count(*) AS m{i}"
                             for i in range(1, 5))
            steps.append(f"""
    c{r + 1} AS (SELECT part, k, {", ".join(f"coalesce(m{i}, x{i}) AS x{i}" for i in range(1, 5))}
      FROM c{r} LEFT JOIN (SELECT part, k, {mean} FROM a{r} GROUP BY part, k) USING (part, k))""")
    return ",".join(steps)


@query("op11_vector_codes", f"""
    WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x:
        CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
      WHERE embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS (SELECT vec_id, label, part, v[4 * part + 1] AS x1, v[4 * part + 2] AS x2, v[4 * part + 3] AS x3,
        v[4 * part + 4] AS x4 FROM v, (SELECT unnest(range(16)) AS part)),{lloyd_sql(2)},
    books AS (SELECT sha256(string_agg(concat_ws(',', x1, x2, x3, x4), ',' ORDER BY part, k)) AS h FROM c2),
    coded AS (SELECT vec_id, label, string_agg(lpad(lower(hex(k)), 2, '0'), '' ORDER BY part) AS code,
        CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec_id, label)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
      h AS codebooks_sha256 FROM coded, books""")
def op11(spark, sf_dir):
    return vector_codes(table(spark, sf_dir, "embeddings")).select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256")


@query("op12_minhash", f"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORD}) AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_sort(list_distinct(list_transform(
        range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS s FROM d),
    class AS (SELECT s, min(doc_id) AS c, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
    e AS (SELECT c, n, unnest(s) AS g FROM class),
    link AS (SELECT a.c AS u, b.c AS v FROM e a JOIN e b ON a.g = b.g AND a.c <> b.c
        AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY a.c, a.n, b.c, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
    reach AS (SELECT c, c AS root FROM class UNION SELECT reach.c, link.v FROM reach JOIN link ON root = u),
    least AS (SELECT s, c, min(root) AS root FROM reach JOIN class USING (c) GROUP BY s, c)
    SELECT doc_id, len(s.s) AS n_shingles, coalesce(root, doc_id) AS component_id,
      doc_id = coalesce(root, doc_id) AS kept FROM s LEFT JOIN least USING (s)""")
def op12(spark, sf_dir):
    return minhash_groups(table(spark, sf_dir, "documents"), shingle=2, percent=80).select(
        "doc_id", "n_shingles", "component_id", "kept")


@query("op13_fill_in_middle", """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''),
        '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
        sha256('42:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
    drawn AS (SELECT doc_id, text, u, len(u) AS n, list_transform([1, 9, 17, 25], lambda i:
        CAST('0x' || substr(h, i, 8) AS BIGINT)) AS h FROM d),
    cut AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
        CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h[3] % 100 >= 50 THEN 'plain'
          WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
    part AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle,
        array_to_string(u[b + 1:], '') AS suffix FROM cut)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
      CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
      sha256(text) AS restored_sha256 FROM part""")
def op13(spark, sf_dir):
    cut = fill_in_middle(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                      F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                      F.sha2(restored().cast("binary"), 256).alias("restored_sha256"))
