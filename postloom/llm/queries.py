"""Queries of this subpackage over the given tables, each with checking SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from postloom.llm.byte_bpe import bpe_decode, bpe_encode, count_ids, load_vocabulary
from postloom.llm.chat import ASSISTANT, END, PART_TURNS, SYSTEM, USER, rotate_perspectives
from postloom.llm.conversation_trie import number_turns, prefix_trie
from postloom.llm.decontaminate import contaminated
from postloom.llm.jaccard_join import jaccard_classes
from postloom.llm.language import fit_languages, load_pieces, predict_language
from postloom.llm.licenses import KNOWN, SPELLINGS, entire_texts, scan_licenses
from postloom.llm.mixing import systematic_mix
from postloom.llm.periodic_runs import find_periodic_runs
from postloom.llm.pii import KINDS, count_kind, find_pii, fit_pii, joined
from postloom.llm.quality import fit_quality, judge_quality
from postloom.llm.scratch import Scratch, broadcast_if_small
from postloom.llm.unit_dedup import dedup_units
from postloom.llm.url_filter import filter_urls, host_of, path_of

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- 1: URL filters ------------------------------------------------------------------

#: Fixed rules: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
OP1_SQL = f"""
with rules(rh, rp, rv) as (values {_RULES_SQL}),
p as (
  select page_id, url,
    coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') path
  from pages),
trap as (
  select host th, regexp_replace(path, '/+$', '') tp from p where host <> '' group by 1, 2 having count(*) >= 2),
hit as (
  select page_id, url, host, path, rh || rp rule, rv,
    row_number() over (partition by page_id, url order by length(rh || rp) desc nulls last) n
  from p left join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp))
select page_id, host, path, rule,
  coalesce(rv, case when th is not null then 'block' else 'allow' end) verdict, th is not null listed
from hit left join trap on host = th and regexp_replace(path, '/+$', '') = tp
where n = 1
"""


@query("op1_url_filter", OP1_SQL)
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every page's url; listed are the canonical urls that were crawled more than once."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.sql(f"select * from values {_RULES_SQL} as rules(host, path, verdict)")
    place = [host_of(F.col("url")), F.regexp_replace(path_of(F.col("url")), "/+$", "")]
    listed = (
        pages.groupBy(place[0].alias("h"), place[1].alias("p")).agg(F.count("*").alias("n"))
        .where("n >= 2 and h <> ''").select(F.concat(F.lit("any://"), "h", "p").alias("listed"))
    )
    return filter_urls(pages, rules, listed).drop("url")


# --- 2: benchmark decontamination ----------------------------------------------------


@query("op2_decontaminate")
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold a benchmark item."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return contaminated(docs.select("doc_id", "text"), items.select("item_id", "text"), short_items=True)


# --- 3: personal data ----------------------------------------------------------------


@query("op3_pii")
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents; the label model and classifier are fitted on all of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_pii(docs, fit_pii(docs))
    counts = [count_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


# --- 4: n-gram Jaccard join ----------------------------------------------------------


@query("op4_jaccard_join")
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document under links of similarity 0.75 and more."""
    return jaccard_classes(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=75)


# --- 5: language ID ------------------------------------------------------------------

#: A public vocabulary; any file of the same kind will do.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from three quarters of the documents, predict the language of all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = fit_languages(docs.where(fold != 2), load_pieces(PIECES))
    rows = docs.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "text")
    return predict_language(rows, model, keep_text=False)


# --- 6: chat formatting --------------------------------------------------------------

OP6_SQL = f"""
with t as (
  select conv_id, turn, coalesce(role, 'unknown') as who, coalesce(text, '') as said, coalesce(cast(floor(turn / {PART_TURNS}) as bigint), 0) part
  from conversations where conv_id is not null),
s as (select distinct conv_id, who speaker from t where who <> 'system'),
g as (
  select t.*, speaker, replace(replace(said, '\\', '\\\\'), '<|', '\\<|') || '{END}' body,
    case when who = speaker then '{ASSISTANT}' when who = 'system' then '{SYSTEM}'
      else '{USER}' || translate(replace(replace(who, '\\', '\\\\'), '<|', '\\<|'), chr(10) || chr(13), '  ') end || chr(10) head
  from t join s using (conv_id)),
p as (
  select *, sum(length(head) + length(body) + 1) over (
    partition by conv_id, speaker, part order by turn nulls first, who, said rows between unbounded preceding and current row) stop from g),
r as (
  select conv_id, speaker, part, string_agg(head || body || chr(10), '' order by turn nulls first, who, said) as text,
    coalesce(string_agg((stop - 1 - length(body)) || ':' || (stop - 1), ',' order by stop) filter (who = speaker), '') mask
  from p group by 1, 2, 3)
select conv_id, speaker, part, text, mask,
  cast(coalesce(sum(length(text)) over (partition by conv_id, speaker order by part rows between unbounded preceding and 1 preceding), 0) as bigint) as offset
from r
"""


@query("op6_chat_format", OP6_SQL)
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as each of its speakers sees it."""
    out = rotate_perspectives(table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return out.withColumn("mask", mask)


# --- 7: mixing sources ---------------------------------------------------------------

OP7_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) size from documents),
s as (select source, cast(sum(size) as bigint) source_size from d group by 1),
w as (select *, row_number() over (order by source nulls last) - 1 place from s),
w2 as (select *, [3.0, 1.0, 2.0][cast(place % 3 as int) + 1]::double weight, source_size * 2.0::double stop from w),
l as (
  select *, ((sum(source_size) over ()) * 1.5::double
      - coalesce(sum(stop) over (order by stop / weight, place rows between unbounded preceding and 1 preceding), 0.0))
    / sum(weight) over (order by stop / weight, place rows between current row and unbounded following) level from w2),
f as (select arg_min(level, stop / weight) final from l where stop > level * weight),
t as (select source, source_size, case when final is null then stop else least(stop, final * weight) end target from l, f),
o as (
  select *, case when source_size > 0 then target / source_size else 0.0 end each,
    cast(cast('0x' || substr(md5('mix:' || coalesce('s' || source, '~')), 1, 8) as bigint) as double) / 4294967296 start
  from t),
r as (
  select doc_id, size, source_size, target, each, start,
    row_number() over (partition by d.source order by floor(log2(size + 1) * 8),
      cast('0x' || substr(md5('mix:' || doc_id), 1, 6) as bigint) % 256, size, md5('mix:' || doc_id)) n
  from d join o on d.source is not distinct from o.source)
select doc_id, cast(size as bigint) size, source_size, target,
  cast(size * (floor(n * each + start) - floor((n - 1) * each + start)) as bigint) taken
from r
"""


@query("op7_mix_sources", OP7_SQL)
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = systematic_mix(docs, weights=[3.0, 1.0, 2.0], share=1.5, ceiling=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


# --- 8: quality rules ----------------------------------------------------------------


@query("op8_quality_rules")
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge all documents; those that labels call good and not toxic are the trusted target."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("trusted")).agg(F.min("quality").alias("good"), F.max("toxic").alias("bad"))
    trusted = broadcast_if_small(labels.where("good = 1 and bad = 0").select("trusted"))
    model = fit_quality(docs.join(trusted, F.col("doc_id") == F.col("trusted"), "left"), F.col("trusted").isNotNull())
    return judge_quality(docs, model, keep_text=False)


# --- 9: licence scans ----------------------------------------------------------------

_KNOWN_SQL = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in KNOWN)


def _lines_sql(text: str) -> str:
    plain = rf"regexp_replace(lower({text}), '[\x00-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f]+', ' ', 'g')"
    kept = f"list_filter(string_split({plain}, chr(10)), lambda x: not regexp_matches(x, '^ *(copyright|©|c copyright|c [0-9]{{4}})'))"
    return f"list_transform({kept}, lambda x: trim(x))"


def _spelled_sql(text: str) -> str:
    out = f"' ' || {text} || ' '"
    for one, other in SPELLINGS:
        out = f"replace({out}, ' {one} ', ' {other} ')"
    return f"trim({out})"


_WHOLE_SQL = "array_to_string(list_filter(l, lambda x: x <> ''), ' ')"
OP9_SQL = f"""
with known(license, license_text) as (values {_KNOWN_SQL}),
k as (select distinct license, {_spelled_sql(_WHOLE_SQL)} c from (select license, {_lines_sql("license_text")} l from known)),
d as (select doc_id, {_lines_sql("text")} l from documents where doc_id is not null and text is not null),
p as (select *, list_filter(string_split_regex(array_to_string(l, chr(10)), '\n\n+'), lambda x: x <> '') parts from d),
u as (
  select doc_id, 0 as level, unnest(l) unit from d
  union all select doc_id, 1, trim(replace(unnest(parts), chr(10), ' ')) from p where len(parts) > 1
  union all select doc_id, 2, {_WHOLE_SQL} from d),
f as (select doc_id, license, level, count(*) places from u join k on {_spelled_sql("unit")} = c group by 1, 2, 3)
select doc_id, license, ['line', 'paragraph', 'text'][max(level) + 1] as level, arg_max(places, level) places from f group by 1, 2
"""


@query("op9_license_scan", OP9_SQL)
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that documents, their paragraphs or lines are."""
    known = spark.createDataFrame([*KNOWN, *entire_texts()], "license string, license_text string")
    return scan_licenses(table(spark, sf_dir, "documents"), known)


# --- 10: substring dedup -------------------------------------------------------------


@query("op10_substring_dedup")
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages that an earlier place has, with what was removed where."""
    out = dedup_units(table(spark, sf_dir, "documents").select("doc_id", "text"), whole_lines=True)
    spans = F.array_join(F.transform("removed", lambda r: F.concat_ws(":", r["start"], r["end"], r["kept_key"])), ",")
    return out.select("doc_id", "text", F.size("removed").cast("long").alias("n_removed"), spans.alias("removed"))


# --- 11: conversation prefix trie ----------------------------------------------------

_WORDS = r"[^\x20\x09-\x0D]+"


def _crc32_sql(number: str) -> str:
    codes = f"list_transform(string_split({number}::varchar, ''), lambda c: ascii(c)::bigint)"
    byte = "list_reduce(list_prepend(xor(a, b), range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {codes}), lambda a, b: {byte}), 4294967295)"


OP11_SQL = f"""
with said as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as said from conversations where conv_id is not null),
hashed as (select *, sha256(length(role) || ':' || role || said) t, len(regexp_extract_all(said, '{_WORDS}')) words from said),
own as (select conv_id, t, words, row_number() over (partition by conv_id order by turn nulls first, left(role || chr(1) || said, 64), t) place from hashed),
info as (select conv_id, {_crc32_sql("conv_id")} % 4 h, conv_id - conv_id % 20 base from (select distinct conv_id from own)),
head as (select i.conv_id, o.place depth, o.t, o.words from info i join own o on o.conv_id = i.base and o.place <= i.h),
taken as (select conv_id, count(*) n from head group by 1),
rebuilt as (
  select * from head union all
  select conv_id, place - h + coalesce(n, 0), t, words from own join info using (conv_id) left join taken using (conv_id) where place > h),
path as (
  select conv_id, depth, words, string_agg(t, '/') over (partition by conv_id order by depth) p from rebuilt
  union all select conv_id, 0, 0, '' from info),
node as (select depth, p, min(conv_id) c, count(*) n, any_value(words) words from path group by 1, 2),
edge as (
  select distinct a.depth, a.p, b.p child, b.depth child_depth from path a join path b on a.conv_id = b.conv_id and b.depth = a.depth + 1),
kids as (select depth, p, count(*) n from edge group by 1, 2),
below as (select distinct a.depth, a.p, b.depth bd, b.p bp from path a join path b on a.conv_id = b.conv_id and b.depth >= a.depth),
total as (
  select b.depth, b.p, count(*) filter (k.n is null) leaves, sum((u.n - 1) * u.words) saved
  from below b join node u on u.depth = bd and u.p = bp left join kids k on k.depth = bd and k.p = bp group by 1, 2),
ends as (
  select depth, p, string_agg(conv_id::varchar, ',' order by conv_id) ids
  from (select conv_id, depth, p from path qualify depth = max(depth) over (partition by conv_id)) group by 1, 2)
select n.c conv_id, n.depth::bigint as depth, par.c parent_conv_id, n.n n_convs, coalesce(k.n, 0) n_children, t.leaves n_leaves,
  t.saved::bigint saved_tokens, sha256(coalesce(e.ids, '')) ends_sha256
from node n join total t using (depth, p) left join kids k using (depth, p) left join ends e using (depth, p)
left join edge up on up.child_depth = n.depth and up.child = n.p left join node par on par.depth = up.depth and par.p = up.p
"""


def _rebuilt(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, turn_hash, words) of every conversation after the first turns that its family
    shares, and all conversations."""
    conv, h = F.col("conv_id"), F.crc32(F.col("conv_id").cast("string")) % 4
    held = numbered.groupBy("_part", "conv_id").agg(F.max("place").alias("last"))  # a long conversation has a row per part
    info = held.groupBy("conv_id").agg(F.max("last").alias("n")).select("conv_id", h.alias("h"), (conv - conv % 20).alias("base"), "n")
    sizes = info.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    info = info.join(sizes, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    shared = numbered.where("place <= 3 and conv_id % 20 = 0").select(F.col("conv_id").alias("base"), "place", "turn_hash", "words")
    head = info.join(shared, "base").where("place <= h").select("conv_id", F.col("place").alias("depth"), "turn_hash", "words")
    by_part = held.select("_part", "conv_id").join(info.select("conv_id", "h", "taken"), "conv_id")
    own = numbered.join(by_part, ["_part", "conv_id"]).where("place > h")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "turn_hash", "words")
    return head.unionAll(own), info.select("conv_id")


@query("op11_conversation_trie", OP11_SQL)
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each with the first turns of its family."""
    scratch = Scratch(spark)
    numbered = number_turns(table(spark, sf_dir, "conversations"), scratch)
    turns, members = _rebuilt(numbered)
    return prefix_trie(turns, members, scratch)


# --- 12: byte-level BPE --------------------------------------------------------------


@query("op12_byte_bpe")
def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, decode the ids again, and digest both."""
    words = load_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = bpe_decode(bpe_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), words), words)
    return coded.select(
        "doc_id", count_ids(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


# --- 13: periodic runs ---------------------------------------------------------------

OP13_SQL = f"""
with d as (select row_number() over () r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') ws, coalesce({_crc32_sql("doc_id")}, 1) h from documents),
n as (select *, len(ws) n, h // 10 g from d),
a as (select *, case when h % 10 = 0 and n > 0 then g % n else n end a from n),
p as (select *, 1 + (n - a) // (3 + g % 8) p from a),
w as (select r, n, i, ws[case when i < a then i else a + (i - a) % p end + 1] w from (select *, unnest(range(n)) i from p)),
pair as (
  select x.r, x.i, y.i - x.i q from w x join w y on x.r = y.r and x.w = y.w and y.i > x.i and 4 * (y.i - x.i) <= x.n),
run as (
  select r, min(i) s, count(*) + q l, q from (select *, i - row_number() over (partition by r, q order by i) island from pair)
  group by r, q, island having count(*) + q >= greatest(6, 4 * q)
  qualify q = min(q) over (partition by r, min(i), count(*) + q)),
best as (
  select r, count(*) n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' order by s, q) listed,
    min_by(struct_pack(s := s, l := l, q := q), struct_pack(l := -l, s := s, q := q)) b from run group by r),
kept as (select w.r, string_agg(w.w, ' ' order by w.i) words from w left join run on run.r = w.r and w.i >= s + q and w.i < s + l where run.r is null group by w.r)
select doc_id, coalesce(n_runs, 0) n_runs, b.s start, b.l length, b.q period, 1000 * b.l // b.q exponent_milli,
  sha256(coalesce(listed, '')) runs_sha256, sha256(coalesce(words, '')) collapsed_sha256
from d left join best using (r) left join kept using (r)
"""


def _with_period(doc_id: Column, text: Column) -> Column:
    """The text whose words repeat from some place on, for a tenth of all documents."""
    h = F.crc32(doc_id.cast("string"))
    words = F.regexp_extract_all(text, F.lit(_WORDS), F.lit(0))
    n, g = F.size(words), F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    periodic = F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), again), F.lit(1), n), " ")
    return F.when((h % 10 == 0) & (n > 0), periodic).otherwise(text)


@query("op13_periodic_runs", OP13_SQL)
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents, a tenth of which are made periodic first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", _with_period(F.col("doc_id"), F.col("text")).alias("text"))
    found = find_periodic_runs(docs)
    ordered = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("best", F.array_max(ordered))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
