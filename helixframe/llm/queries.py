"""The thin queries opN_<name> over the synthetic tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; the files are installed beside the workers' Python."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicate_classes

    return near_duplicate_classes(table(spark, sf_dir, "documents"), threshold=0.8)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import build_trees, read_back

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], rows.schema)
    tokens = vocabulary("byte_bpe_50k.json")
    return read_back(build_trees(rows.unionByName(extra), tokens), tokens)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge_quality

    own = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"]
    return judge_quality(table(spark, sf_dir, "documents")).select(*own)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import digest, find_secrets

    return digest(find_secrets(table(spark, sf_dir, "documents")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_passages

    return find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), threshold=0.8)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive, read_all

    pages = table(spark, sf_dir, "pages")
    _, directory = archive(pages, least_bytes=1000)
    return read_all(pages, directory)


#: The contract's rules.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
#: The list that decides where none of them fits: hosts named by two of these words, and paths, at every top level.
LIST_WORDS = (
    ("ads", "adult", "bet", "bonus", "casino", "cheap", "click", "free", "loan", "pills", "poker", "spam"),
    ("best", "bets", "bonus", "club", "deal", "farm", "now", "online", "pills", "shop", "track", "win", "x", "zone"),
)
LIST_PATHS = ("/ads/", "/banner/", "/click/", "/popup/", "/redirect/", "/track/")
TOP_LEVELS = ("com", "net", "org")
URL_LIST = [("block", f"{a}-{b}.example.{t}/") for a in LIST_WORDS[0] for b in LIST_WORDS[1] for t in TOP_LEVELS] + [("block", f"{t}{p}") for p in LIST_PATHS for t in TOP_LEVELS]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .url_filter import build, judge_urls, rule_table

    by_rule = judge_urls(table(spark, sf_dir, "pages"), build(rule_table(spark, URL_RULES)))
    own = ["page_id", "host", "path", "rule"]
    first = by_rule.select("page_id", "url", F.struct(*own, "verdict").alias("found"))
    both = judge_urls(first.select(F.struct("page_id", "found").alias("row"), "url"), build(rule_table(spark, URL_LIST)), id_col="row")
    verdict = F.coalesce(F.col("row.found.verdict"), F.col("verdict"), F.lit("allow"))
    return both.select("row.page_id", "row.found.host", "row.found.path", "row.found.rule", verdict.alias("verdict"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import digest, find_pii

    return digest(find_pii(table(spark, sf_dir, "documents")))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_count import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=512)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_order_minhash": op1_order_minhash,
    "op2_chat_format": op2_chat_format,
    "op3_quality_rules": op3_quality_rules,
    "op4_secret_scan": op4_secret_scan,
    "op5_decontamination": op5_decontamination,
    "op6_warc": op6_warc,
    "op7_url_filter": op7_url_filter,
    "op8_pii": op8_pii,
    "op9_token_counts": op9_token_counts,
    "op10_best_fit_packing": op10_best_fit_packing,
}

_DIGEST = "sha1(coalesce(html, ''))"
_BYTES = "octet_length(encode(coalesce(html, '')))"
_LAST = f"max(page_id) over (partition by {_DIGEST})"

#: Code points that escaping adds to a text: one for each backslash and each control string.
_ESCAPES = (
    "(length({0}) - length(replace({0}, '\\', '')) + len(regexp_extract_all({0}, "
    "'<s>|</s>|\\[INST\\]|\\[/INST\\]|<<SYS>>|<</SYS>>|<\\|im_start\\|>|<\\|im_end\\|>|<\\|endoftext\\|>')))"
)
_SAYS = "'</s>[INST] ok [/INST]'"

_LISTED = ", ".join(f"('{r[: r.index('/')]}', '{r[r.index('/') :]}', '{v}', true)" for v, r in URL_LIST)
#: Rows without a conversation id are conversations of their own.
_OWN = "case when conv_id is null then row_number() over () end"

SQL: dict[str, str] = {
    "op2_chat_format": f"""
        with turns as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, {_OWN} as own from conversations
            union all select -7, 0, 'user', {_SAYS}, null union all select -7, 1, 'assistant', {_SAYS}, null)
        select conv_id, count(*) as n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
            cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
            sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
            cast(sum(length('<s>[INST][/INST]</s>') + length(role) + length(text) + {_ESCAPES.format("role")} + {_ESCAPES.format("text")}) as bigint) as formatted_chars
        from turns group by conv_id, own""",
    "op6_warc": f"""
        with marked as (
            select page_id, {_BYTES} as payload_bytes, {_DIGEST} as payload_digest, {_LAST} as last_id
            from pages)
        select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
            case when payload_bytes >= 1000 and page_id < last_id then 'revisit' else 'response' end as record_type,
            case when payload_bytes >= 1000 and page_id < last_id then last_id end as refers_to
        from marked""",
    "op7_url_filter": f"""
        with parts as (
            select page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
                coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') as path
            from pages),
        rules(rule_host, rule_path, rule_verdict, listed) as (values
            ('com', '/en/', 'block', false), ('example.com', '/en/7', 'allow', false), ('net', '/de/', 'block', false),
            ('example.net', '/de/8', 'block', false), ('org', '/es/', 'block', false),
            {_LISTED}),
        fits as (
            select *, row_number() over (partition by page_id, host, path order by listed, length(rule_host || rule_path) desc, length(rule_host) desc) as k
            from parts join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path))
        select p.page_id, p.host, p.path,
            case when not f.listed then f.rule_host || f.rule_path end as rule,
            coalesce(f.rule_verdict, 'allow') as verdict
        from parts p left join fits f on f.page_id = p.page_id and f.host = p.host and f.path = p.path and f.k = 1""",
}
