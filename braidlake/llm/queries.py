"""Queries and oracle SQL of the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlake.llm import conversations, cooccurrence, leakage, lookalike, mixing, names, neardup, pii, qa_defects, splitting
from braidlake.runtime import read_table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    messages = pii.pii_items(read_table(spark, d, "messages"), "id", "content", "messages")
    files = pii.pii_items(read_table(spark, d, "files"), "id", "text", "files")
    # Account numbers are masked, but aren't among the types this result is made of.
    return messages.unionByName(files).where("pii_type <> 'ACCOUNT'").select("tab", "row_id", "pii_type", "char_start")


def p1_masked(spark: SparkSession, d: str) -> DataFrame:
    messages = read_table(spark, d, "messages").select(F.lit("messages").alias("tab"), "id", F.col("content").alias("text"))
    files = read_table(spark, d, "files").select(F.lit("files").alias("tab"), "id", "text")
    return pii.mask_pii(messages.unionByName(files).distinct(), "text", "masked").select("tab", "id", "masked")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = cooccurrence.cooccurrence(read_table(spark, d, "entity_chunks"), "node_id", ["source", "chunk_id"], 6, 6.0)
    return pairs.select("id_a", "id_b")


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = cooccurrence.cooccurrence(read_table(spark, d, "entity_chunks"), "node_id", ["source", "chunk_id"], 6, 6.0)
    return pairs.select("id_a", "id_b", "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"), F.round("conviction", 6).alias("conviction"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return names.name_pairs(read_table(spark, d, "v2_entities"), "id", "name", "type")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    done = read_table(spark, d, "chunks").select("source").where(F.col("source").startswith("file-")).distinct()
    # Offsets are small, texts aren't: files are cut first, and the pieces of those that have chunks drop out after.
    cut = splitting.pieces_of_long_texts(read_table(spark, d, "files"), "id", "text", texts=False)
    open_files = cut.withColumn("source", F.concat(F.lit("file-"), F.col("id").cast("string"))).join(done, "source", "left_anti")
    return open_files.select(F.col("id").alias("file_id"), "char_start", "char_end")


def _chunk_keys(chunks: DataFrame) -> DataFrame:
    return chunks.where("source is not null and chunk_id is not null").select(F.concat_ws("_", "source", F.col("chunk_id").cast("string")).alias("key"), "text")


def _scoped(spark: SparkSession, d: str) -> DataFrame:
    """(tab, key, text) of files and chunks. Both run as one, each a scope of its own; the common prefix of the keys leaves
    their order as it is."""
    files = read_table(spark, d, "files").select(F.col("id").cast("string").alias("key"), "text").withColumn("tab", F.lit("files"))
    both = files.unionByName(_chunk_keys(read_table(spark, d, "chunks")).withColumn("tab", F.lit("chunks")))
    return both.select("tab", F.concat("tab", F.lit("\u001f"), "key").alias("key"), "text")


def _unscoped(column: str) -> Column:
    return F.regexp_replace(column, "^(files|chunks)\u001f", "").alias(column)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = neardup.near_duplicate_pairs(_scoped(spark, d), "key", "text", 3, 0.6, "tab")
    return found.select(F.substring_index("key_a", "\u001f", 1).alias("tab"), _unscoped("key_a"), _unscoped("key_b"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    found = neardup.near_duplicate_groups(_scoped(spark, d), "key", "text", 3, 0.6, "tab")
    return found.select(F.substring_index("key", "\u001f", 1).alias("tab"), _unscoped("key"), _unscoped("group_id"), "group_size")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.defects(read_table(spark, d, "messages"), read_table(spark, d, "sessions"))


def p6_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversations(read_table(spark, d, "messages"), read_table(spark, d, "sessions"))


def p6_turns(spark: SparkSession, d: str) -> DataFrame:
    """The turns of the sessions without a defect, in order."""
    found = conversations.conversations(read_table(spark, d, "messages"), read_table(spark, d, "sessions"))
    first = found.groupBy("session_id").agg(F.min("turn").alias("_first"))
    return found.join(first, "session_id").select("session_id", (F.col("turn") - F.col("_first") + 1).alias("turn"), "id", "role")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return qa_defects.answer_defects(read_table(spark, d, "predictions"), "id", "question", "generated_answer", "error")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.leaks(read_table(spark, d, "documents"), "doc_id", "text", read_table(spark, d, "eval_items"), "item_id", ["evidence", "answer"])
    return found.select("doc_id", "item_id").distinct()


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(
        read_table(spark, d, "documents"), "doc_id", "text", read_table(spark, d, "eval_items"), "item_id", ["evidence", "answer"], substitutions=1
    )


def p8_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """The longest overlap of each document with each side of an item, word for word."""
    found = leakage.leaks(read_table(spark, d, "documents"), "doc_id", "text", read_table(spark, d, "eval_items"), "item_id", ["evidence", "answer"])
    return found.select("doc_id", "item_id", "side", "overlap")


def p8_joined(spark: SparkSession, d: str) -> DataFrame:
    """The same by joined seeds, the way of test sets beyond the bound of a broadcast."""
    found = leakage.leaks(read_table(spark, d, "documents"), "doc_id", "text", read_table(spark, d, "eval_items"), "item_id", ["evidence", "answer"], seed_bound=0)
    return found.select("doc_id", "item_id", "side", "overlap")


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(read_table(spark, d, "documents"), "doc_id", "text", "source", read_table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(read_table(spark, d, "documents"), "doc_id", "text", "source", read_table(spark, d, "mix_targets"))[1]


def p9_total(spark: SparkSession, d: str) -> DataFrame:
    """Shares reached with a stated total, about the tokens of the whole corpus: small sources are repeated up to their cap."""
    documents = read_table(spark, d, "documents")
    total = documents.agg(F.coalesce(F.sum("n_chars"), F.lit(0)).alias("n")).first()["n"] // 4
    return mixing.mixture(documents, "doc_id", "text", "source", read_table(spark, d, "mix_targets"), total_tokens=total)[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_alike_pairs(read_table(spark, d, "documents"), "doc_id", "text")


def p10_texts(spark: SparkSession, d: str) -> DataFrame:
    unified = lookalike.unify_look_alikes(read_table(spark, d, "documents").select("doc_id", "text"), "text", "unified")
    return unified.select("doc_id", "unified")


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_alike_classes(read_table(spark, d, "documents"), "doc_id", "text")


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    return names.name_classes(read_table(spark, d, "v2_entities"), "id", "name", "type")


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            p1_found, p1_masked, p2_found, p2_pairs, p3_found, p4_found, p5_found, p5_groups, p6_found, p6_conversations, p6_turns, p7_found, p8_found, p8_leaks, p8_overlaps, p8_joined, p9_mixture, p9_shares, p9_total, p10_found, p10_texts, p10_classes, p3_classes,
        )
    }


_PAIRS = """
with r as (select distinct node_id, source, chunk_id from entity_chunks where node_id is not null and source is not null and chunk_id is not null),
n as (select node_id, count(*) as n from r group by 1),
t as (select count(*) as n from (select distinct source, chunk_id from r)),
p as (select a.node_id as id_a, b.node_id as id_b, count(*) as n_ab from r a join r b on a.source = b.source and a.chunk_id = b.chunk_id and a.node_id < b.node_id group by 1, 2 having count(*) >= 6)
"""
_FROM = " from p join n x on x.node_id = id_a join n y on y.node_id = id_b cross join t where n_ab * t.n >= 6 * x.n * y.n"


_OVERLAPS = r"""
with i as (select distinct item_id, 0 as side, evidence as passage from eval_items union all select distinct item_id, 1, answer from eval_items), iw as (select item_id, side, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') as w from i where passage is not null),
ik as (select item_id, side, w, unnest(range(1, len(w) - 10)) as a from iw where len(w) >= 12), ig as (select item_id, side, a, array_to_string(w[a:a + 11], ' ') as g from ik),
dw as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where text is not null), dk as (select doc_id, w, unnest(range(1, len(w) - 10)) as b from dw where len(w) >= 12), dg as (select doc_id, b, array_to_string(w[b:b + 11], ' ') as g from dk),
m as (select distinct doc_id, item_id, side, b - a as diagonal, a from dg join ig using (g)), r as (select *, a - row_number() over (partition by doc_id, item_id, side, diagonal order by a) as island from m),
n as (select doc_id, item_id, side, count(*) + 11 as overlap from r group by doc_id, item_id, side, diagonal, island)
select doc_id, item_id, side, max(overlap)::int as overlap from n group by 1, 2, 3"""


_DEFECTS = r"""
with m as (select distinct session_id, id, trim(lower(role), e' \t\r\n') as role, content, created_at from messages where session_id is not null and content is not null and trim(content, e' \t\r\n') <> ''),
u as (select * from m where role is null or role <> 'system'),
v as (select *, lag(session_id) over w is not null and role is not distinct from lag(role) over w and content = lag(content) over w as again from u window w as (partition by session_id order by created_at, id)),
t as (select *, row_number() over w as k, lag(role) over w as before, lead(role) over w as after from v where not again window w as (partition by session_id order by created_at, id)),
d as (select session_id, bool_or(role is null or role not in ('user', 'assistant') or role = 'assistant' and (k = 1 or coalesce(before = 'assistant', false))) as broken, bool_or(coalesce(role = 'user', false) and not coalesce(after = 'assistant', false)) as missing from t group by 1),
s as (select distinct id as session_id from sessions where id is not null),
df as (select coalesce(d.session_id, s.session_id) as session_id, case when d.session_id is null then 'empty' when s.session_id is null or broken then 'broken' else 'missing_reply' end as defect
from s full join d on s.session_id = d.session_id where d.session_id is null or s.session_id is null or broken or missing)"""
_NEAR_KEYS = (("files", "id::varchar"), ("chunks", "source || '_' || chunk_id"))
_NEAR = r"""with r as (select distinct {key} as k, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') as w from {tab} where text is not null),
s as (select distinct k, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) as g from r where len(w) >= 3), n as (select k, count(*) as n from s group by 1),
p as (select a.k as key_a, b.k as key_b, count(*) as c from s a join s b on a.g = b.g and a.k < b.k group by 1, 2)
select key_a, key_b from p join n x on x.k = key_a join n y on y.k = key_b where c >= 0.6 * (x.n + y.n - c)"""


def _look_alike_sql() -> str:
    """Texts by one fixed form: every class of look-alikes takes its lowest member, then marks are composed by the engine."""
    plain, longer = {}, {}
    for own in lookalike.look_alikes().values():
        chosen = "" if "" in own else min(own, key=lambda x: (not x.isascii(), len(x), x))
        for x in own:
            if len(x) == 1 and x != chosen and not (len(chosen) == 1 and ord(x) > 0xFFFF and ord(chosen) > 0xFFFF):
                (plain if len(chosen) == 1 else longer)[x] = chosen
    dropped = "".join(sorted(x for x, y in longer.items() if not y))
    text = f"translate(text, '{''.join(plain)}{dropped}', '{''.join(plain.values()).replace(chr(39), chr(39) * 2)}')"
    for x, y in sorted(longer.items()):
        if y and y.isascii():
            text = f"replace({text}, '{x}', '{y}')"
    return f"""with f as (select doc_id, text, md5(nfc_normalize({text})) as form from documents where text is not null),
g as (select * from f where form in (select form from f group by 1 having count(distinct text) > 1))
select distinct a.doc_id as doc_a, b.doc_id as doc_b from g a join g b on a.form = b.form and a.doc_id < b.doc_id and a.text <> b.text"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": r"""
with recursive f as (select distinct id, text from files where length(text) > 1200 and 'file-' || id not in (select source from chunks where source is not null)),
x as (select id, length(text) as n, regexp_extract_all(text, '[^ \t\r\n]+|[ \t\r\n]+') as ts from f), y as (select id, unnest(range(1, len(ts) + 1)) as k, ts from x), t as (select id, k, ts[k] as token, sum(length(ts[k])) over (partition by id order by k) - length(ts[k]) as pos from y),
v as (select *, lag(token) over w as gap, lag(token, 2) over w as word from t window w as (partition by id order by k)),
b as (select id, pos, case when length(gap) - length(replace(gap, chr(10), '')) > 1 then 3 when contains(gap, chr(10)) then 2 when coalesce(right(word, 1), '') in ('.', '!', '?') then 1 else 0 end as kind from v where not regexp_matches(token, '^[ \t\r\n]') and gap is not null),
p as (select id, n, 0::bigint as s from x union all select id, n, s from (select id, n, coalesce(min(pos), any_value(e) - 120)::bigint as s from
(select q.id, q.n, q.e, c.pos from (select p.id, p.n, p.s, coalesce(max(b.kind * 1000000000000 + b.pos) % 1000000000000, p.s + 1200)::bigint as e from p left join b on b.id = p.id and b.pos > p.s + 600 and b.pos <= p.s + 1200 where p.n - p.s > 1200 group by p.id, p.n, p.s) q left join b c on c.id = q.id and c.pos >= q.e - 120 and c.pos < q.e) group by id, n))
select p.id as file_id, p.s as char_start, case when p.n - p.s <= 1200 then p.n else coalesce(max(b.kind * 1000000000000 + b.pos) % 1000000000000, p.s + 1200) end::bigint as char_end
from p left join b on b.id = p.id and b.pos > p.s + 600 and b.pos <= p.s + 1200 group by p.id, p.n, p.s""",
        "p8_overlaps": _OVERLAPS,
        "p8_joined": _OVERLAPS,
        "p2_found": _PAIRS + "select id_a, id_b" + _FROM,
        "p2_pairs": _PAIRS
        + "select id_a, id_b, n_ab, x.n as n_a, y.n as n_b, round(n_ab * t.n / (x.n::double * y.n), 6) as lift, case when n_ab < x.n then round((1 - y.n / t.n) / (1 - n_ab / x.n), 6) end as conviction"
        + _FROM,
        "p6_found": _DEFECTS + " select session_id, defect from df",
        "p6_turns": _DEFECTS + " select session_id, row_number() over (partition by session_id order by created_at, id) as turn, id, role from t where session_id not in (select session_id from df)",
        "p5_groups": "\nunion all\n".join(
            f"""select * from (with recursive pr as ({_NEAR.format(key=key, tab=tab)}), u as (select key_a as a, key_b as b from pr union all select key_b, key_a from pr), m as (select distinct {key} as k from {tab} where text is not null and len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) >= 3),
rc as (select k, k as low from m union select u.b, rc.low from rc join u on u.a = rc.k), g as (select k, min(low) as group_id from rc group by 1) select '{tab}' as tab, k as key, group_id, count(*) over (partition by group_id) as group_size from g where k is not null)"""
            for tab, key in _NEAR_KEYS
        ),
        "p10_found": _look_alike_sql(),
        "p8_found": r"""
with i as (select item_id, unnest([evidence, answer]) as passage from eval_items), iw as (select item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') as w from i where passage is not null),
ig as (select distinct item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) as g from iw where len(w) >= 12),
dw as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where text is not null),
dg as (select doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) as g from dw where len(w) >= 12)
select distinct doc_id, item_id from dg join ig using (g)""",
        "p5_found": "\nunion all\n".join(f"select '{tab}' as tab, key_a, key_b from ({_NEAR.format(key=key, tab=tab)})" for tab, key in _NEAR_KEYS),
    }
