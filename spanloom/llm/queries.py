"""One query for each operator, with production parameters over the whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, merkle, mixing, near_dedup, search, simhash, suffix_dedup, token_count, toxicity, url_filter, warc, winnow
from ._spark import read


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(read(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(read(spark, sf_dir, "pages"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.digest(decontam.find(docs, read(spark, sf_dir, "benchmark")))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.format_turns(chat.canonical_rows(spark, sf_dir)))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_count.count_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return counted.select("row.doc_id", "n_words", "n_tokens")


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.digest(read(spark, sf_dir, "documents"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.summary(read(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), k=2, threshold=80)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.summary(read(spark, sf_dir, "documents"))


_ALL = (op1_url_filters, op2_source_mixing, op3_warc, op4_benchmark_decontamination, op5_chat_formatting, op6_token_counts, op7_winnowing, op8_suffix_array_dedup, op9_minhash_near_dedup, op10_toxicity, op11_simhash_near_dedup, op12_ranked_search, op13_merkle_manifest)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SPACED, _ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDS = lambda text, rx: f"regexp_extract_all(translate(coalesce({text}, ''), {_LOWER}), '{rx}')"

#: What grows by one character when op5 escapes it: backslashes, and control strings of chat templates.
_MARKS = r"""'\\|<\|(?:turn|text|end|im_start|im_end|endoftext|system|user|assistant)\|>|</?s>|\[/?INST\]|<</?SYS>>'"""

_FIELD = lambda value: f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"
_LEAF = lambda n_chars: f"sha256({' || '.join(map(_FIELD, ('doc_id', 'source', 'lang', n_chars, 'text')))})"

#: The CRC-32 of an id's digits, bit by bit: 2**32 marks the step that takes a byte in.
_CRC = """CAST(xor(list_reduce(
                list_prepend(CAST(4294967295 AS UBIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ord(c) AS UBIGINT) + 4294967296, 0, 0, 0, 0, 0, 0, 0]))),
                lambda a, b: xor(CASE WHEN b > 0 THEN xor(a, b - 4294967296) ELSE a END >> 1, CASE WHEN (CASE WHEN b > 0 THEN xor(a, b - 4294967296) ELSE a END) % 2 = 1 THEN 3988292384 ELSE 0 END)), CAST(4294967295 AS UBIGINT)) AS BIGINT)"""

#: XXH64 in 128-bit arithmetic: its five primes, a product and a rotation of 64 bits, and the little-endian number at a byte of a hex string.
_P = (0, 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
_TWO64 = "CAST(18446744073709551616 AS UHUGEINT)"
_times = lambda x, p: f"(CAST(({x}) AS UHUGEINT) * CAST({p} AS UHUGEINT)) % {_TWO64}"
_turned = lambda x, r: f"((({x}) << {r}) % {_TWO64} + (({x}) >> {64 - r}))"
_number = lambda at, n: "CAST(CAST('0x' || " + " || ".join(f"substr(hx, 2 * ({at}) + {2 * i + 1}, 2)" for i in reversed(range(n))) + " AS UBIGINT) AS UHUGEINT)"
_lane = lambda v, at: f"({v} + {_times(_number(at, 8), _P[2])}) % {_TWO64} AS {v}"

#: DuckDB SQL of the queries that SQL can express over whole tables.
ORACLE_SQL: dict[str, str] = {
    "op1_url_filters": f"""
        WITH parts AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), split AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {_LOWER}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
        ), rules(pattern, host_part, path_part, verdict) AS (VALUES
            ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'block'),
            ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')
        ), ranked AS (
            SELECT s.page_id, s.host, s.path, r.pattern, r.verdict, row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.pattern) DESC NULLS LAST) AS place
            FROM split s LEFT JOIN rules r ON (s.host = r.host_part OR ends_with(s.host, '.' || r.host_part)) AND starts_with(s.path, r.path_part)
        )
        SELECT page_id, host, path, pattern AS rule, coalesce(verdict, 'allow') AS verdict FROM ranked WHERE place = 1""",
    "op3_warc": f"""
        WITH bytes AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        judged AS (
            SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest,
                   max(page_id) OVER (PARTITION BY sha1(payload)) AS holder FROM bytes
        )
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> holder THEN holder END AS refers_to
        FROM judged""",
    "op5_chat_formatting": f"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), sized AS (
            SELECT *, length(role) + length(text) + len(regexp_extract_all(role, {_MARKS})) + len(regexp_extract_all(text, {_MARKS})) + {len("<|turn|>" + "<|text|>" + "<|end|>")} AS size FROM rows
        ), whole AS (
            SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS lines,
                   coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS learnt, sum(size) AS chars
            FROM sized GROUP BY conv_id
        )
        SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(lines) AS turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars,
               sha256(learnt) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM whole""",
    "op4_benchmark_decontamination": rf"""
        WITH dw AS (SELECT doc_id, {_WORDS("text", _ALNUM)} AS w FROM documents), iw AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS("text", _ALNUM)} AS w FROM benchmark),
        sized AS (SELECT item, w, least(10, len(w)) AS size FROM iw WHERE len(w) > 0),
        windows AS (SELECT DISTINCT item, size, array_to_string(w[pos : pos + size - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS pos FROM sized)),
        grams AS (SELECT doc_id, size, pos, array_to_string(w[pos : pos + size - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS pos FROM dw, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
        met AS (SELECT g.doc_id, g.pos, g.size, v.item FROM grams g JOIN windows v ON v.size = g.size AND v.gram = g.gram),
        hits AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS place FROM met) GROUP BY doc_id),
        named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM met) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(n.n, 0) AS n_items, sha256(coalesce(n.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
        FROM dw d LEFT JOIN hits h ON h.doc_id = d.doc_id LEFT JOIN named n ON n.doc_id = d.doc_id""",
    "op8_suffix_array_dedup": rf"""
        WITH dw AS (SELECT doc_id, {_WORDS("text", _SPACED)} AS w FROM documents),
        windows AS (SELECT doc_id, pos, md5(array_to_string(w[pos : pos + 49], ' ')) AS gram FROM (SELECT *, unnest(range(1, len(w) - 48)) AS pos FROM dw WHERE len(w) >= 50)),
        judged AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY gram) AS n, row_number() OVER (PARTITION BY gram ORDER BY doc_id, pos) AS place FROM windows),
        covered AS (SELECT doc_id, word, bool_or(later) AS later FROM (SELECT doc_id, unnest(range(pos, pos + 50)) AS word, place > 1 AS later FROM judged WHERE n > 1) GROUP BY doc_id, word),
        counted AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE later) AS gone FROM covered GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_repeated, coalesce(c.gone, 0) AS n_removed FROM dw d LEFT JOIN counted c ON c.doc_id = d.doc_id""",
    "op9_minhash_near_dedup": rf"""
        WITH RECURSIVE dw AS (SELECT doc_id, {_WORDS("text", _SPACED)} AS w FROM documents),
        sets AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[pos] || ' ' || w[pos + 1] END AS shingle FROM (SELECT *, unnest(range(1, greatest(len(w), 2))) AS pos FROM dw WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
        links AS (SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)),
        both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other),
        least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
        SELECT l.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id, l.doc_id = l.component_id AS kept FROM least l LEFT JOIN sizes s ON s.doc_id = l.doc_id""",
    "op11_simhash_near_dedup": f"""
        WITH RECURSIVE dw AS (SELECT doc_id, {_WORDS("text", _SPACED)} AS w FROM documents),
        shingles AS (SELECT doc_id, array_to_string(w[pos : pos + 2], ' ') AS shingle FROM (SELECT *, unnest(range(1, greatest(len(w) - 1, 2))) AS pos FROM dw WHERE len(w) > 0)),
        different AS (SELECT shingle, hex(encode(shingle)) AS hx, strlen(shingle) AS size FROM (SELECT DISTINCT shingle FROM shingles)),
        stripes(shingle, hx, size, spot, a, b, c, d) AS (
            SELECT shingle, hx, size, 0, CAST({(42 + _P[1] + _P[2]) % 2**64} AS UHUGEINT), CAST({42 + _P[2]} AS UHUGEINT), CAST(42 AS UHUGEINT), CAST({(42 - _P[1]) % 2**64} AS UHUGEINT) FROM different
            UNION ALL SELECT shingle, hx, size, spot + 32, {", ".join(_times(_turned(v, 31), _P[1]) for v in "abcd")}
            FROM (SELECT shingle, hx, size, spot, {", ".join(_lane(v, f"spot + {8 * i}") for i, v in enumerate("abcd"))} FROM stripes WHERE spot + 32 <= size)
        ), striped AS (SELECT * FROM stripes WHERE spot + 32 > size),
        merged AS (SELECT shingle, hx, size, spot, ({_turned("a", 1)} + {_turned("b", 7)} + {_turned("c", 12)} + {_turned("d", 18)}) % {_TWO64} AS h, {", ".join(f"{_times(_turned('x' + v, 31), _P[1])} AS {v}" for v in "abcd")}
            FROM (SELECT *, {", ".join(f"{_times(v, _P[2])} AS x{v}" for v in "abcd")} FROM striped)),
        joined AS (SELECT shingle, hx, size, spot, list_reduce(list_prepend(h, [a, b, c, d]), lambda x, y: ({_times("xor(x, y)", _P[1])} + {_P[4]}) % {_TWO64}) AS h FROM merged),
        tails(shingle, hx, size, spot, h) AS (
            SELECT shingle, hx, size, spot, ((CASE WHEN size >= 32 THEN h ELSE {42 + _P[5]} END) + CAST(size AS UHUGEINT)) % {_TWO64} FROM joined
            UNION ALL SELECT shingle, hx, size, spot + step, CASE step WHEN 8 THEN ({_times(_turned("h", 27), _P[1])} + {_P[4]}) % {_TWO64} WHEN 4 THEN ({_times(_turned("h", 23), _P[2])} + {_P[3]}) % {_TWO64} ELSE {_times(_turned("h", 11), _P[1])} END
            FROM (SELECT shingle, hx, size, spot, step, xor(h, CASE step WHEN 8 THEN {_times(_turned("x", 31), _P[1])} WHEN 4 THEN x ELSE x END) AS h
                FROM (SELECT *, CASE step WHEN 8 THEN {_times(_number("spot", 8), _P[2])} WHEN 4 THEN {_times(_number("spot", 4), _P[1])} ELSE {_times(_number("spot", 1), _P[5])} END AS x
                    FROM (SELECT *, CASE WHEN spot + 8 <= size THEN 8 WHEN spot + 4 <= size THEN 4 ELSE 1 END AS step FROM tails WHERE spot < size)))
        ), first AS (SELECT shingle, {_times("xor(h, h >> 33)", _P[2])} AS h FROM tails WHERE spot = size), second AS (SELECT shingle, {_times("xor(h, h >> 29)", _P[3])} AS h FROM first),
        hashes AS (SELECT shingle, CAST(xor(h, h >> 32) AS UBIGINT) AS h FROM second),
        votes AS (SELECT doc_id, count(*) AS n, {", ".join(f"sum((h >> {i}) & 1) AS b{i}" for i in range(64))} FROM shingles s JOIN hashes x ON x.shingle = s.shingle GROUP BY doc_id),
        prints AS (SELECT d.doc_id, coalesce(f, CAST(0 AS UBIGINT)) AS f FROM documents d LEFT JOIN (SELECT doc_id, CAST({" + ".join(f"CASE WHEN 2 * b{i} > n THEN CAST({2**i} AS UHUGEINT) ELSE 0 END" for i in range(64))} AS UBIGINT) AS f FROM votes) v ON v.doc_id = d.doc_id),
        nodes AS (SELECT f, min(doc_id) AS least FROM prints GROUP BY f), links AS (SELECT x.f AS a, y.f AS b FROM nodes x JOIN nodes y ON x.f <> y.f AND bit_count(xor(x.f, y.f)) <= 2),
        reach(f, other) AS (SELECT f, f FROM nodes UNION SELECT r.f, l.b FROM reach r JOIN links l ON l.a = r.other),
        least AS (SELECT r.f, min(n.least) AS component_id FROM reach r JOIN nodes n ON n.f = r.other GROUP BY r.f)
        SELECT p.doc_id, lower(lpad(hex(p.f), 16, '0')) AS fingerprint, coalesce(l.component_id, p.doc_id) AS component_id FROM prints p JOIN least l ON l.f = p.f""",
    "op12_ranked_search": f"""
        WITH dw AS (SELECT doc_id, unnest({_WORDS("text", _TERMS)}) AS term FROM documents),
        tfs AS (SELECT doc_id, term, count(*) AS tf FROM dw GROUP BY doc_id, term), lengths AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tfs GROUP BY doc_id),
        whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
        weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tfs, whole GROUP BY term, docs),
        gains AS (SELECT t.doc_id, t.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + ((75 * n * docs) // terms)))) AS gain FROM tfs t JOIN lengths l ON l.doc_id = t.doc_id JOIN weights v ON v.term = t.term, whole),
        wanted AS (SELECT item_id, unnest({_WORDS("text", _TERMS)}) AS term FROM benchmark),
        scores AS (SELECT item_id, doc_id, CAST(sum(gain) AS BIGINT) AS score FROM wanted i JOIN gains g ON g.term = i.term GROUP BY item_id, doc_id),
        ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
        SELECT * FROM ranked WHERE rank <= 10""",
    "op13_merkle_manifest": f"""
        WITH RECURSIVE leaves AS (
            SELECT doc_id, coalesce('=' || lang, '') AS grp, {_LEAF("n_chars")} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {_LEAF("n_chars + 1")} END AS other FROM documents
        ), placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM leaves),
        nodes(grp, depth, pos, node, n) AS (
            SELECT grp, 0, pos, leaf, n FROM placed
            UNION ALL SELECT grp, depth + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY grp, depth, pos // 2, n
        ), subroots AS (SELECT grp, node AS subroot, row_number() OVER (ORDER BY encode(grp)) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
        tops(depth, pos, node, n) AS (
            SELECT 0, pos, subroot, n FROM subroots
            UNION ALL SELECT depth + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (n + 1) // 2 FROM tops WHERE n > 1 GROUP BY depth, pos // 2, n
        ), walks(doc_id, grp, leaf, depth, pos, n, own, beside) AS (
            SELECT doc_id, grp, leaf, 0, pos, n, coalesce(other, leaf), '' FROM placed
            UNION ALL SELECT w.doc_id, w.grp, w.leaf, w.depth + 1, w.pos // 2, (w.n + 1) // 2, sha256(CASE WHEN w.pos % 2 = 1 THEN s.node || w.own ELSE w.own || coalesce(s.node, '') END), w.beside || coalesce(s.node, '')
            FROM walks w LEFT JOIN nodes s ON s.grp = w.grp AND s.depth = w.depth AND s.pos = xor(w.pos, 1) WHERE w.n > 1
        ), climbs(doc_id, grp, leaf, subroot, depth, pos, n, own, beside) AS (
            SELECT w.doc_id, w.grp, w.leaf, s.subroot, 0, s.pos, s.n, w.own, w.beside FROM walks w JOIN subroots s ON s.grp = w.grp WHERE w.n = 1
            UNION ALL SELECT w.doc_id, w.grp, w.leaf, w.subroot, w.depth + 1, w.pos // 2, (w.n + 1) // 2, sha256(CASE WHEN w.pos % 2 = 1 THEN s.node || w.own ELSE w.own || coalesce(s.node, '') END), w.beside || coalesce(s.node, '')
            FROM climbs w LEFT JOIN tops s ON s.depth = w.depth AND s.pos = xor(w.pos, 1) WHERE w.n > 1
        )
        SELECT c.doc_id, c.leaf, c.subroot, t.node AS root, sha256(c.beside) AS proof_sha256, c.own AS folded_root, c.own = t.node AS verified FROM climbs c, tops t WHERE c.n = 1 AND t.n = 1""",
}
