"""Registered queries over the driver tables, and the SQL that says the same."""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import similarity as S
from ..functions import text as X
from ..functions import tokens as T
from ..operators import clones, metrics, normalize, pair_features, splits
from . import tuning

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
HASHES, BANDS, SHINGLE = 48, 16, 3


def query(sql: str | None = None):
    """Register a function under its name, with the SQL of the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- corpora and pair lists --------------------------------------------------------------------


def documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), "lang")


def turns(spark, sf_dir) -> DataFrame:
    """Turns of conversations as short snippets."""
    own = table(spark, sf_dir, "conversations")
    return own.select((F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).distinct()


def commented(spark, sf_dir) -> DataFrame:
    """Documents dressed as code: a block comment before, blank lines and a line comment after, a string inside."""
    text = F.concat(F.lit("/* "), F.substring("text", 1, 40), F.lit("\n */  String s = \"// kept\"; "), F.col("text"), F.lit("\n\n  // end \"x\" "), F.col("id").cast("string"))
    return documents(spark, sf_dir).select("id", text.alias("text"))


def neighbours(corpus: DataFrame, most: int = 3) -> DataFrame:
    """Pairs of ids at most ``most`` apart, by an equi-join."""
    other = corpus.select((F.col("id")).alias("id2"))
    own = corpus.select(F.col("id").alias("id1"), F.explode(F.sequence(F.lit(1), F.lit(most))).alias("k"))
    return own.select("id1", (F.col("id1") + F.col("k")).alias("id2")).join(other, "id2", "left_semi").select("id1", "id2")


def class_pairs(corpus: DataFrame) -> DataFrame:
    """Each document with the smallest one of equal text."""
    own = clones.classes(corpus, F.md5("text"))
    return own.where("id != class_id").select(F.col("class_id").alias("id1"), F.col("id").alias("id2"))


def pair_list(spark, sf_dir) -> DataFrame:
    own = documents(spark, sf_dir)
    return class_pairs(own).union(neighbours(own)).distinct()


def scored(spark, sf_dir) -> DataFrame:
    """Labelled documents with a fixed score."""
    own = table(spark, sf_dir, "labels")
    return own.select("doc_id", F.col("quality").cast("int").alias("label"), F.col("toxic").cast("int").alias("toxic"), (F.pmod(F.col("doc_id") * 37, F.lit(101)) / 100.0).alias("score")).where("doc_id is not null and label is not null")


DOCS = "docs as (select doc_id as id, coalesce(text, '') as text, lang from documents)"
TURNS = "turns as (select distinct (conv_id * 1000 + turn)::bigint as id, coalesce(text, '') as text from conversations)"
COMMENTED = "src as (select id, '/* ' || left(text, 40) || chr(10) || ' */  String s = \"// kept\"; ' || text || chr(10) || chr(10) || '  // end \"x\" ' || id::varchar as text from docs)"
LEX = r"""'(?s)"(?:[^"\\]|\\.)*(?:"|\\?\z)|''(?:[^''\\]|\\.)*(?:''|\\?\z)|//[^\n]*|/\*.*?(?:\*/|\z)|[^"''/]+|/'"""
BARE = f"""bare as (select id, text, array_to_string(list_transform(regexp_extract_all(text, {LEX}), lambda s: case when starts_with(s, '//') then '' when starts_with(s, '/*') then regexp_replace(s, '[^\\n]', '', 'g') else s end), '') as b from src)"""
TRIM = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '[ \t\r]+', ' ', 'g'), '(^|\n) +', '\1', 'g'), '\n+', chr(10), 'g'), '^\n|\n\z', '', 'g')"""
NORM = f"norm as (select id, text, {TRIM.format('b')} as n from bare)"
NLINES = "(case when {0} = '' then 0 else length({0}) - length(replace({0}, chr(10), '')) + 1 end)::bigint"
NTOKENS = r"(len(regexp_extract_all({0}, '[^\s\x0b\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+')))::bigint"
NCHARS = "length({0})::bigint"
CLASS_PAIRS = "cp as (select m as id1, id as id2 from (select id, min(id) over (partition by md5(text)) as m from docs) where id <> m)"
NEIGHBOURS = "nb as (select a.id as id1, b.id as id2 from docs a join docs b on b.id - a.id between 1 and 3)"
PAIRS = f"{CLASS_PAIRS}, {NEIGHBOURS}, pairs as (select * from cp union select * from nb)"
SCORED = "scored as (select doc_id, quality::int as label, toxic::int as toxic, ((doc_id * 37) % 101) / 100.0::double as score from labels where doc_id is not null and quality is not null)"


# --- text --------------------------------------------------------------------------------------


@query(f"with {DOCS}, {COMMENTED}, {BARE} select id, b as bare_text from bare")
def strip_comments(spark, sf_dir):
    return commented(spark, sf_dir).select("id", X.remove_comments(F.col("text")).alias("bare_text"))


@query(f"with {DOCS}, {COMMENTED}, {BARE}, {NORM} select id, n as norm_text from norm")
def normalize_source(spark, sf_dir):
    return normalize.normalized(commented(spark, sf_dir)).select("id", "norm_text")


@query(f"select page_id as id, {TRIM.format(chr(34) + 'html' + chr(34))} as norm_text from pages")
def norm_whitespace_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), X.normalize_whitespace(F.col("html")).alias("norm_text"))


_IMPACT = ", ".join(
    f"{m.format('text')} as original_{k}, {m.format('n')} as normalized_{k}, greatest({m.format('text')} - {m.format('n')}, 0)::bigint as {k}_removed"
    for k, m in (("lines", NLINES), ("tokens", NTOKENS), ("chars", NCHARS))
)


@query(f"with {DOCS}, {COMMENTED}, {BARE}, {NORM} select id, {_IMPACT} from norm")
def norm_impact(spark, sf_dir):
    return normalize.impact(commented(spark, sf_dir))


_MEASURES = [f"{a}{k}{b}" for k in ("lines", "tokens", "chars") for a, b in (("original_", ""), ("normalized_", ""), ("", "_removed"))]


@query(
    f"with {DOCS}, {COMMENTED}, {BARE}, {NORM}, i as (select id, {_IMPACT} from norm) select "
    + ", ".join(f"round(avg({m}), 6) as avg_{m}" for m in _MEASURES)
    + ", sum(lines_removed)::bigint as total_lines_removed, sum(tokens_removed)::bigint as total_tokens_removed, count(*) as snippets from i"
)
def norm_impact_summary(spark, sf_dir):
    return normalize.impact_summary(normalize.impact(commented(spark, sf_dir)))


@query(
    f"with {DOCS}, m as (select lang, {NLINES.format('text')} as lines, {NTOKENS.format('text')} as tokens, {NCHARS.format('text')} as chars from docs) select lang, "
    + ", ".join(
        f"round(avg({c}), 6) as {c}_mean, round(stddev_pop({c}), 6) as {c}_std, min({c}) as {c}_min, max({c}) as {c}_max, round(quantile_cont({c}, 0.5), 6) as {c}_median"
        for c in ("lines", "tokens", "chars")
    )
    + " from m group by lang"
)
def length_stats(spark, sf_dir):
    return normalize.length_stats(documents(spark, sf_dir), "lang")


# --- tokens ------------------------------------------------------------------------------------

# other engines have no possessive quantifiers and, without backtracking, no need of them
_JAVA = T.JAVA.replace(']++', ']+').replace(')*+', ')*').replace("'", "''")
_LIST = lambda words: ", ".join(f"'{w}'" for w in words)
_CATEGORY = (
    f"case when t in ({_LIST(T.MODIFIERS)}) then 4 when t in ({_LIST(T.KEYWORDS)}) then 0 when t in ({_LIST(T.TRUTH)}) then 3 when t in ({_LIST(T.SEPARATORS)}) then 6 "
    "when left(t, 1) in ('\"', '''') or left(t, 1) between '0' and '9' then 3 when regexp_matches(left(t, 1), '[\\p{L}_$]') then 1 "
    "when regexp_matches(t, '^[-+*/%=<>!&|^~?.:]+$') then 2 else 255 end"
)
TOKENS = f"tokens as (select id, list_transform(regexp_extract_all(n, '{_JAVA}'), lambda t: {_CATEGORY}) as k from norm where trim(n) <> '')"
CODE = f"{DOCS}, {COMMENTED}, {BARE}, {NORM}, {TOKENS}"
TALK = f"{TURNS}, src as (select * from turns), {BARE}, {NORM}, {TOKENS}"


@query(f"with {CODE} select k::bigint as category, count(*) as n from (select unnest(k) as k from tokens) group by 1")
def token_category_counts(spark, sf_dir):
    return normalize.category_totals(normalize.tokenized(commented(spark, sf_dir))).select(F.col("category").cast("long").alias("category"), "n")


_CC = "(1 + len(list_filter(k, lambda t: t in (0, 2))))::bigint"


@query(f"with {CODE} select round(avg(len(k)), 6) as tokens_mean, round(quantile_cont(len(k), 0.5), 6) as tokens_median, max(len(k))::bigint as tokens_max, round(avg({_CC}), 6) as cc_mean from tokens")
def token_stats(spark, sf_dir):
    return normalize.token_summary(normalize.tokenized(commented(spark, sf_dir)))


@query(f"with {CODE} select id, {_CC} as cyclomatic from tokens")
def cyclomatic(spark, sf_dir):
    return normalize.tokenized(commented(spark, sf_dir)).select("id", T.cyclomatic(F.col("tokens")).alias("cyclomatic"))


_HIST = "list_transform(range(0, 12), lambda c: len(list_filter({0}, lambda t: t = c)))"


@query(f"with {CODE} select id, array_to_string({_HIST.format('k')}, ',') as histogram from tokens")
def token_histogram(spark, sf_dir):
    own = normalize.tokenized(commented(spark, sf_dir))
    return own.select("id", F.array_join(F.transform(T.count_categories(F.col("tokens")), lambda n: n.cast("string")), ",").alias("histogram"))


@query()
def token_records(spark, sf_dir):
    """Token records of the light syntax tree, flat."""
    own = normalize.token_records(commented(spark, sf_dir))
    a = F.col("ast")
    return own.select("id", "token_count", a["max_depth"].alias("max_depth"), a["node_count"].alias("node_count"), F.size(a["bigrams"]).cast("long").alias("bigrams"), a["cyclomatic_complexity"].alias("cyclomatic_complexity"))


# --- exact and renamed copies ------------------------------------------------------------------


_SPACED = "src as (select id, case id % 3 when 0 then text when 1 then replace(text, ' ', '  ') || chr(10) else '/* ' || id || ' */' || text end as text from docs)"


@query(f"with {DOCS}, {_SPACED}, {BARE}, {NORM} select id, min(id) over w as class_id, count(*) over w as class_size from norm window w as (partition by md5(n))")
def type1_classes(spark, sf_dir):
    """Exact copies; two thirds of the texts are given other blanks or a comment first, which normalization takes away."""
    k = F.col("id") % 3
    text = F.when(k == 0, F.col("text")).when(k == 1, F.concat(F.replace("text", F.lit(" "), F.lit("  ")), F.lit("\n"))).otherwise(F.concat(F.lit("/* "), F.col("id").cast("string"), F.lit(" */"), F.col("text")))
    own = normalize.normalized(documents(spark, sf_dir).select("id", text.alias("text")))
    return clones.classes(own, F.md5("norm_text"))


@query(f"with {CODE} select id, min(id) over w as class_id, count(*) over w as class_size from tokens window w as (partition by md5(array_to_string(k, ' ')))")
def type2_classes(spark, sf_dir):
    own = normalize.tokenized(commented(spark, sf_dir))
    return clones.classes(own, F.md5(S.spelled(F.col("tokens"))))


def _digests(corpus: DataFrame) -> DataFrame:
    own = normalize.normalized(corpus)
    return own.select("id", F.md5("norm_text").alias("norm_md5"), F.md5(S.spelled(T.categories(F.col("norm_text")))).alias("token_md5"))


def _typed(spark, sf_dir) -> DataFrame:
    corpus = documents(spark, sf_dir)
    return clones.clone_types(pair_list(spark, sf_dir), _digests(corpus))


TYPED = (
    f"{DOCS}, src as (select id, text from docs), {BARE}, {NORM}, {PAIRS}, dig as (select id, md5(n) as m, md5(array_to_string(list_transform(regexp_extract_all(n, '{_JAVA}'), lambda t: {_CATEGORY}), ' ')) as k from norm), "
    "typed as (select id1, id2, case when a.m = b.m then 1 when a.k = b.k then 2 else 0 end as clone_type from pairs join dig a on a.id = id1 join dig b on b.id = id2)"
)


@query(f"with {TYPED} select * from typed")
def clone_types(spark, sf_dir):
    return _typed(spark, sf_dir)


@query(f"with {TYPED} select clone_type, count(*) as n from typed group by 1")
def clone_type_counts(spark, sf_dir):
    return _typed(spark, sf_dir).groupBy("clone_type").agg(F.count("*").alias("n"))


# --- shingles, signatures, bands ---------------------------------------------------------------

_PACK = f"list_transform(range(1, len(k) - {SHINGLE} + 2), lambda i: " + " + ".join(f"k[i + {j}]::bigint * {256 ** (SHINGLE - 1 - j)}" for j in range(SHINGLE)) + ")"


@query(f"with {CODE}, s as (select id, case when len(k) >= {SHINGLE} then {_PACK} else [] end as s from tokens) select id, len(s)::bigint as shingles, len(list_distinct(s))::bigint as distinct_shingles, coalesce(list_sum(s), 0)::bigint as checksum from s")
def shingle_counts(spark, sf_dir):
    own = normalize.tokenized(commented(spark, sf_dir)).select("id", H.packed_shingles(F.col("tokens"), SHINGLE).alias("s"))
    total = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x)
    return own.select("id", F.size("s").cast("long").alias("shingles"), F.size(F.array_distinct("s")).cast("long").alias("distinct_shingles"), total.alias("checksum"))


def _signed(spark, sf_dir, hashes: int = HASHES) -> DataFrame:
    return clones.signatures(clones.word_shingles(documents(spark, sf_dir), SHINGLE), hashes)


SIGNED = (
    f"{DOCS}, w as (select id, list_filter(string_split(text, ' '), lambda x: x <> '') as w from docs), g as (select distinct id, unnest(list_transform(range(1, len(w) - {SHINGLE} + 2), lambda i: array_to_string(w[i:i + {SHINGLE} - 1], ' '))) as g from w where len(w) >= {SHINGLE}), "
    "sh as (select id, ('0x' || left(md5(g), 7))::bigint as x from g), sig as (select id, " + ", ".join(f"min((x * {a} + {b}) % {H.PRIME}) as m{i}" for i, (a, b) in enumerate(H.coefficients(HASHES))) + " from sh group by id)"
)
_ROWS = HASHES // BANDS
KEYED = f"{SIGNED}, keyed as (select id, [" + ", ".join("concat_ws('-', " + ", ".join(f"m{b * _ROWS + r}" for r in range(_ROWS)) + ")" for b in range(BANDS)) + "] as bands from sig)"


@query(f"with {SIGNED} select * from sig")
def minhash_signatures(spark, sf_dir):
    return _signed(spark, sf_dir)


def _keyed(spark, sf_dir) -> DataFrame:
    return clones.band_keys(_signed(spark, sf_dir), HASHES, BANDS)


@query(f"with {KEYED} select id, (b - 1)::bigint as band, bands[b] as bucket from keyed, range(1, {BANDS + 1}) t(b)")
def lsh_buckets(spark, sf_dir):
    return clones.buckets(_keyed(spark, sf_dir))


_SHARED = " or ".join(f"a.bands[{b}] = b.bands[{b}]" for b in range(1, BANDS + 1))
FILTERED = f"{KEYED}, {PAIRS}, hit as (select id1, id2 from pairs join keyed a on a.id = id1 join keyed b on b.id = id2 where {_SHARED})"


@query(f"with {FILTERED} select * from hit")
def lsh_pair_filter(spark, sf_dir):
    return clones.filtered(pair_list(spark, sf_dir), _keyed(spark, sf_dir))


def _one_per_text(spark, sf_dir) -> DataFrame:
    own = documents(spark, sf_dir)
    return own.join(clones.classes(own, F.md5("text")).where("id = class_id").select("id"), "id", "left_semi")


_DISTINCT = KEYED.replace(DOCS, "docs as (select min(doc_id) as id, coalesce(text, '') as text from documents group by coalesce(text, ''))")


@query(f"with {_DISTINCT}, bk as (select id, b, bands[b] as k from keyed, range(1, {BANDS + 1}) t(b)) select distinct x.id as id1, y.id as id2 from bk x join bk y on x.b = y.b and x.k = y.k and x.id < y.id")
def lsh_candidates(spark, sf_dir):
    """All pairs of different texts that share a bucket; copies are in ``type1_classes``."""
    signed = clones.signatures(clones.word_shingles(_one_per_text(spark, sf_dir), SHINGLE), HASHES)
    return clones.bucket_pairs(clones.buckets(clones.band_keys(signed, HASHES, BANDS)))


@query(
    f"with {_DISTINCT}, bk as (select id, b, bands[b] as k from keyed, range(1, {BANDS + 1}) t(b)), sized as (select *, count(*) over (partition by b, k) as n from bk) select distinct x.id as id1, y.id as id2 from sized x join sized y on x.b = y.b and x.k = y.k and x.id < y.id where x.n <= 4"
)
def lsh_candidates_capped(spark, sf_dir):
    """The same with the bucket cap of the operator set to 4."""
    signed = clones.signatures(clones.word_shingles(_one_per_text(spark, sf_dir), SHINGLE), HASHES)
    return clones.bucket_pairs(clones.buckets(clones.band_keys(signed, HASHES, BANDS)), 4)


_SAME = " + ".join(f"(a.m{i} = b.m{i})::int" for i in range(HASHES))


@query(f"with {SIGNED}, {PAIRS} select id1, id2, floor(({_SAME}) * 10000 / {HASHES}) / 10000 as similarity from pairs join sig a on a.id = id1 join sig b on b.id = id2")
def minhash_similarity(spark, sf_dir):
    return clones.agreement(pair_list(spark, sf_dir), _signed(spark, sf_dir), HASHES)


@query(f"with {SIGNED}, {PAIRS} select id1, id2 from pairs join sig a on a.id = id1 join sig b on b.id = id2 where floor(({_SAME}) * 10000 / {HASHES}) / 10000 >= 0.35")
def minhash_filter(spark, sf_dir):
    return minhash_similarity(spark, sf_dir).where("similarity >= 0.35").select("id1", "id2")


@query(
    f"with {FILTERED}, total as (select count(*) as n from pairs), j as (select count(*) as c, count(t.id1) as r from hit left join cp t using (id1, id2)), k as (select count(*) as t from cp) "
    "select n as pairs_before, c as pairs_after, t as true_pairs, r as true_retained, case when n > 0 then round(1 - c / n, 6) else 0 end as reduction, coalesce(round(r / nullif(t, 0), 6), 0) as candidate_recall, coalesce(round(r / nullif(c, 0), 6), 0) as candidate_precision from total, j, k"
)
def lsh_metrics(spark, sf_dir):
    pairs = pair_list(spark, sf_dir)
    total = F.broadcast(pairs.agg(F.count("*").alias("_total")))
    hit = clones.filtered(pairs, _keyed(spark, sf_dir))
    truth = class_pairs(documents(spark, sf_dir))
    out = clones.candidate_metrics(hit, truth, 1)
    share = lambda a, b: F.coalesce(F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), 6), F.lit(0.0))
    out = out.drop("pairs_before", "reduction").join(total)
    return out.select(
        F.col("_total").alias("pairs_before"), "pairs_after", "true_pairs", "true_retained",
        F.when(F.col("_total") > 0, F.round(1 - F.col("pairs_after") / F.col("_total"), 6)).otherwise(0.0).alias("reduction"),
        share("true_retained", "true_pairs").alias("candidate_recall"), share("true_retained", "pairs_after").alias("candidate_precision"),
    )


# --- pair features -----------------------------------------------------------------------------


def _talk_pairs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    own = normalize.tokenized(turns(spark, sf_dir))
    return neighbours(own, 1), own


TALK_PAIRS = f"{TALK}, tp as (select a.id as id1, b.id as id2, a.k as k1, b.k as k2 from tokens a join tokens b on b.id = a.id + 1)"
_U, _I = "len(list_distinct(list_concat(k1, k2)))", "len(list_intersect(k1, k2))"


@query(
    f"with {TALK_PAIRS}, sp as (select *, array_to_string(k1, ' ') as s1, array_to_string(k2, ' ') as s2 from tp) select id1, id2, round(case when len(k1) = 0 and len(k2) = 0 then 1 when len(k1) = 0 or len(k2) = 0 then 0 else {_I} / {_U} end, 6) as token_jaccard, "
    f"round(case when len(k1) = 0 and len(k2) = 0 then 1 when len(k1) = 0 or len(k2) = 0 then 0 else 2 * {_I} / (len(list_distinct(k1)) + len(list_distinct(k2))) end, 6) as token_dice, "
    "round(case when s1 = '' or s2 = '' then 0 else jaccard(s1, s2) end, 6) as char_jaccard, "
    "round(coalesce(1 - levenshtein(s1, s2) / nullif(greatest(length(s1), length(s2)), 0), 1), 6) as levenshtein_ratio from sp"
)
def feat_lexical(spark, sf_dir):
    pairs, own = _talk_pairs(spark, sf_dir)
    full = clones.attach(pairs, own, ["tokens"])
    a, b = F.col("tokens1"), F.col("tokens2")
    x, y = S.spelled(a), S.spelled(b)
    return full.select("id1", "id2", *(F.round(v, 6).alias(k) for k, v in {"token_jaccard": S.jaccard(a, b), "token_dice": S.dice(a, b), "char_jaccard": S.char_jaccard(x, y), "levenshtein_ratio": S.levenshtein_ratio(x, y)}.items()))


@query()
def feat_lcs_ratio(spark, sf_dir):
    pairs, own = _talk_pairs(spark, sf_dir)
    full = clones.attach(pairs, own, ["tokens"])
    return full.select("id1", "id2", F.round(S.lcs_ratio("tokens1", "tokens2"), 6).alias("lcs_ratio"))


_DOT = "list_dot_product({0}::double[], {1}::double[])"
_H1, _H2 = _HIST.format("k1"), _HIST.format("k2")
_B = "list_transform(range(1, len({0})), lambda i: {0}[i] * 256 + {0}[i + 1])"


@query(
    f"with {TALK_PAIRS}, h as (select *, {_H1} as h1, {_H2} as h2, {_B.format('k1')} as b1, {_B.format('k2')} as b2 from tp), o as (select *, len(list_filter(b1, lambda x: list_contains(b2, x))) as i from h) "
    f"select id1, id2, round(coalesce({_DOT.format('h1', 'h2')} / nullif(sqrt({_DOT.format('h1', 'h1')}) * sqrt({_DOT.format('h2', 'h2')}), 0), 0), 6) as hist_cosine, "
    "round(case when len(b1) = 0 or len(b2) = 0 then 0 else i / (len(b1) + len(b2) - i) end, 6) as bigram_overlap from o"
)
def feat_structural(spark, sf_dir):
    """Histogram cosine and the overlap of bigrams of neighbouring categories."""
    pairs, own = _talk_pairs(spark, sf_dir)
    n = F.size("tokens")
    two = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.when(n > 1, n - 1).otherwise(1)), lambda i: F.element_at("tokens", i) * 256 + F.element_at("tokens", i + 1))).otherwise(F.array().cast("array<int>"))
    full = clones.attach(pairs, own.select("id", T.count_categories(F.col("tokens")).alias("h"), two.alias("b")), ["h", "b"])
    return full.select("id1", "id2", F.round(S.cosine(F.col("h1"), F.col("h2")), 6).alias("hist_cosine"), F.round(S.bigram_overlap(F.col("b1"), F.col("b2")), 6).alias("bigram_overlap"))


_R = "coalesce(least({0}, {1}) / nullif(greatest({0}, {1}), 0), 1)"
_ID = "len(list_filter({0}, lambda t: t = 1))"


@query(
    f"with {TALK_PAIRS}, m as (select tp.*, {NLINES.format('x.text')} as l1, {NLINES.format('y.text')} as l2, {NCHARS.format('x.text')} as c1, {NCHARS.format('y.text')} as c2 from tp join turns x on x.id = id1 join turns y on y.id = id2) select id1, id2, "
    f"round({_R.format('len(k1)', 'len(k2)')}, 6) as token_ratio, round(coalesce(2 * least({_ID.format('k1')}, {_ID.format('k2')}) / nullif({_ID.format('k1')} + {_ID.format('k2')}, 0), 1), 6) as identifier_ratio, "
    "round(abs(l1 - l2) / greatest(l1, l2, 1), 6) as line_delta, round(least(c1, c2) / greatest(c1, c2, 1), 6) as char_ratio from m"
)
def feat_ratios(spark, sf_dir):
    pairs, own = _talk_pairs(spark, sf_dir)
    raw = turns(spark, sf_dir).select("id", X.count_lines(F.col("text")).alias("l"), X.count_chars(F.col("text")).alias("c"))
    full = clones.attach(clones.attach(pairs, own, ["tokens"]), raw, ["l", "c"])
    out = {
        "token_ratio": S.ratio(F.size("tokens1"), F.size("tokens2")),
        "identifier_ratio": S.identifier_ratio(F.col("tokens1"), F.col("tokens2")),
        "line_delta": F.abs(F.col("l1") - F.col("l2")) / F.greatest("l1", "l2", F.lit(1)),
        "char_ratio": F.least("c1", "c2") / F.greatest("c1", "c2", F.lit(1)),
    }
    return full.select("id1", "id2", *(F.round(v, 6).alias(k) for k, v in out.items()))


def _features(spark, sf_dir, parity: bool) -> DataFrame:
    corpus = turns(spark, sf_dir)
    records = normalize.token_records(corpus)
    return pair_features.pair_features(neighbours(corpus, 1), pair_features.describe(corpus, records), parity)


@query()
def pair_feature_table(spark, sf_dir):
    return _features(spark, sf_dir, False)


@query()
def pair_feature_table_parity(spark, sf_dir):
    return _features(spark, sf_dir, True)


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "with long as ("
    + " union all ".join(f"select '{c}' as feature, {c}::double as value from lineitem" for c in _NUMBERS)
    + ") select feature, count(*) as n, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, round(min(value), 6) as min, round(max(value), 6) as max, round(quantile_cont(value, 0.25), 6) as q25, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.75), 6) as q75 from long group by feature"
)
def feature_metrics(spark, sf_dir):
    return pair_features.feature_metrics(table(spark, sf_dir, "lineitem"), _NUMBERS)


@query(" union all ".join(f"select '{a}' as feature1, '{b}' as feature2, round(corr({a}, {b}), 6) as r from lineitem" for i, a in enumerate(_NUMBERS) for b in _NUMBERS[i:]))
def feature_correlation(spark, sf_dir):
    return pair_features.correlations(table(spark, sf_dir, "lineitem"), _NUMBERS)


@query(
    "with long as ("
    + " union all ".join(f"select l_returnflag, '{c}' as feature, {c}::double as value from lineitem" for c in _NUMBERS)
    + ") select l_returnflag, feature, count(value) as n, "
    + ", ".join(f"round(quantile_cont(value, {q}), 6) as {k}" for q, k in ((0, "low"), (0.25, "q25"), (0.5, "median"), (0.75, "q75"), (1, "high")))
    + " from long group by 1, 2"
)
def class_distributions(spark, sf_dir):
    return metrics.distributions(table(spark, sf_dir, "lineitem"), "l_returnflag", _NUMBERS)


@query("select o_orderkey, case when isnan(v) or v = '-infinity'::double then 0 when v = 'infinity'::double then 1 else v end as v from (select o_orderkey, case o_orderkey % 4 when 0 then 'nan'::double when 1 then 'infinity'::double when 2 then '-infinity'::double else o_totalprice::double end as v from orders)")
def sanitized(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    v = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf")).otherwise(F.col("o_totalprice").cast("double"))
    return pair_features.sanitized(table(spark, sf_dir, "orders").select("o_orderkey", v.alias("v")), ["v"])


# --- labels, samples, splits -------------------------------------------------------------------

_SETS = ["type1", "type2", "type3", "type4", "type5", "nonclone", "unknown"]
_SET_SQL = "case o_orderkey % 7 " + " ".join(f"when {i} then '{s}'" for i, s in enumerate(_SETS)) + " end"


@query(
    f"with s as (select o_orderkey, {_SET_SQL} as clone_set from orders) select clone_set, case when clone_set = 'type1' then 1 when clone_set = 'type2' then 2 when clone_set in ('type3', 'type4') then 3 when clone_set in ('type5', 'nonclone') then 0 else -1 end as test_label, "
    "case when clone_set in ('type3', 'type4') then 1 when clone_set in ('type5', 'nonclone') then 0 else -1 end as training_label, count(*) as n from s group by 1, 2, 3"
)
def label_assignment(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.element_at(F.array(*map(F.lit, _SETS)), (F.col("o_orderkey") % 7 + 1).cast("int")).alias("clone_set"))
    return own.groupBy("clone_set", splits.test_label(F.col("clone_set")).alias("test_label"), splits.training_label(F.col("clone_set")).alias("training_label")).agg(F.count("*").alias("n"))


_RANKED = "r as (select *, row_number() over (partition by {0} order by md5(concat_ws('-', {1}, '42')), {1}) as rank, count(*) over (partition by {0}) as size from {2})"


@query(f"with {_RANKED.format('o_orderstatus', 'o_orderkey', 'orders')} select o_orderkey, o_orderstatus, case when rank <= floor(size * 0.3 + 0.5) then 'test' else 'train' end as split from r")
def stratified_split(spark, sf_dir):
    return splits.stratified_split(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["o_orderkey"])


@query(f"with {_RANKED.format('o_orderstatus', 'o_orderkey', 'orders')}, m as (select min(size) as least from r) select o_orderkey, o_orderstatus from r, m where rank <= least")
def balanced_undersample(spark, sf_dir):
    return splits.balanced(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["o_orderkey"])


@query(f"with {_RANKED.format('o_orderstatus', 'o_orderkey', 'orders')} select o_orderkey, o_orderstatus, ((rank - 1) % 5)::bigint as fold from r")
def kfold_assign(spark, sf_dir):
    return splits.folds(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["o_orderkey"])


@query(f"with {_RANKED.format('o_orderstatus', 'o_orderkey', 'orders')} select o_orderkey, o_orderstatus from r where rank <= 50")
def random_subset(spark, sf_dir):
    return splits.subset(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["o_orderkey"], 50)


@query(
    f"with {_RANKED.format('o_orderstatus', 'o_orderkey', 'orders')}, t as (select *, row_number() over (order by md5(concat_ws('-', o_orderkey, '42')), o_orderkey) as place from orders)"
    " select 'train' as part, o_orderkey, o_orderstatus from r where rank <= 20 union all select 'test', o_orderkey, o_orderstatus from t where place <= 100"
)
def quick_subset(spark, sf_dir):
    """The small tables of a trial run; the limit is the feature."""
    own = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    parts = splits.quick(own, own, "o_orderstatus", ["o_orderkey"], 20)
    return reduce(DataFrame.union, (df.select(F.lit(name).alias("part"), "*") for name, df in zip(("train", "test"), parts, strict=True)))


@query("select l_orderkey as id1, l_linenumber as id2, (o_orderstatus = 'F')::int as label, l_quantity::double as lex_a, l_tax::double as quant_b from lineitem join orders on o_orderkey = l_orderkey where l_linenumber > 1")
def labelled_features(spark, sf_dir):
    """A feature table joined with the labels of its pairs and pruned to the selected features."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id1"), F.col("l_linenumber").alias("id2"), *(F.col(c).cast("double").alias(n) for c, n in (("l_quantity", "lex_a"), ("l_discount", "lex_c"), ("l_tax", "quant_b"))))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id1"), (F.col("o_orderstatus") == "F").cast("int").alias("label"))
    pairs = rows.select("id1", "id2").where("id2 > 1").join(orders, "id1")
    return pair_features.selected(pair_features.labelled(rows, pairs), ["lex_a", "quant_b", "not_there"])


@query("select o_orderstatus, count(*) as n, round(count(*) / (select count(*) from orders), 4) as share from orders group by 1")
def label_distribution(spark, sf_dir):
    own = table(spark, sf_dir, "orders")
    counts = own.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    whole = F.broadcast(own.agg(F.count("*").alias("all")))
    return counts.join(whole).select("o_orderstatus", "n", F.round(F.col("n") / F.col("all"), 4).alias("share"))


_LOOSE = "lp as (select id as id1, id + 7 as id2, lang from docs)"


@query(f"with {DOCS}, {_LOOSE} select id1, id2, lang from lp where id2 in (select id from docs)")
def valid_pairs(spark, sf_dir):
    own = documents(spark, sf_dir)
    return splits.existing(own.select(F.col("id").alias("id1"), (F.col("id") + 7).alias("id2"), "lang"), own, "lang")[0]


@query(f"with {DOCS}, {_LOOSE}, f as (select lang, id2 in (select id from docs) as good from lp) select lang, count(*) as original, count(*) filter (good) as valid, count(*) filter (not good) as removed from f group by lang")
def removal_stats(spark, sf_dir):
    own = documents(spark, sf_dir)
    return splits.existing(own.select(F.col("id").alias("id1"), (F.col("id") + 7).alias("id2"), "lang"), own, "lang")[1]


@query("select o_custkey as custkey, max_by(o_orderkey, o_orderkey) as last_order, max_by(o_orderstatus, o_orderkey) as status from orders group by 1")
def last_wins(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("last_order"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("order"))
    return clones.last_wins(own, ["custkey"], "order").drop("order")


@query("select distinct least(l_partkey, l_suppkey) as id1, greatest(l_partkey, l_suppkey) as id2 from lineitem")
def canonical_pairs(spark, sf_dir):
    return clones.canonical(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id1"), F.col("l_suppkey").alias("id2"))).distinct()


@query("select distinct id from (select l_partkey as id from lineitem union all select l_suppkey from lineitem)")
def distinct_ids(spark, sf_dir):
    return normalize.distinct_ids(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id1"), F.col("l_suppkey").alias("id2")))


# --- evaluation --------------------------------------------------------------------------------

_CELLS = "count(*) filter (label = 1 and hit) as tp, count(*) filter (label = 0 and hit) as fp, count(*) filter (label = 0 and not hit) as tn, count(*) filter (label = 1 and not hit) as fn"
_SCORES = (
    "round(coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0), 0), 6) as accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, "
    "round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) as fpr, round(coalesce(fn / nullif(fn + tp, 0), 0), 6) as fnr"
)


@query(f"with {SCORED}, c as (select {_CELLS} from (select label, score >= 0.3 as hit from scored)) select tp, fp, tn, fn, {_SCORES} from c")
def classification_metrics(spark, sf_dir):
    return metrics.classification(metrics.confusion(scored(spark, sf_dir), F.col("label"), (F.col("score") >= 0.3).cast("int")))


BY_SCORE = "g as (select score, count(*) filter (label = 1) as p, count(*) filter (label = 0) as n from scored group by score), d as (select score, p, n, (sum(p) over w)::bigint as tp, (sum(n) over w)::bigint as fp from g window w as (order by score desc rows unbounded preceding))"


@query(f"with {SCORED}, {BY_SCORE} select round(coalesce(sum((tp - p) * n + p * n / 2) / nullif(sum(p) * sum(n), 0), 0), 6) as roc_auc from d")
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(scored(spark, sf_dir), "label", "score")


@query(f"with {SCORED}, {BY_SCORE} select round(coalesce(sum(p * tp / (tp + fp)) / nullif(sum(p), 0), 0), 6) as average_precision from d")
def average_precision(spark, sf_dir):
    return metrics.average_precision(scored(spark, sf_dir), "label", "score")


@query(f"with {SCORED}, {BY_SCORE} select score, round(coalesce(fp / nullif(sum(n) over (), 0), 0), 6) as fpr, round(coalesce(tp / nullif(sum(p) over (), 0), 0), 6) as tpr, round(tp / (tp + fp), 6) as precision, round(max(tp / (tp + fp)) over (order by score desc rows between current row and unbounded following), 6) as envelope from d")
def curve_points(spark, sf_dir):
    return metrics.curves(scored(spark, sf_dir), "label", "score")


@query(
    f"with {SCORED}, {BY_SCORE}, c as (select round(coalesce(fp / nullif(sum(n) over (), 0), 0), 6) as x0, round(coalesce(tp / nullif(sum(p) over (), 0), 0), 6) as y0 from d), o as (select x0 as x, max(y0) as y from c group by x0), "
    "s as (select x, y, lead(x) over w as x2, lead(y) over w as y2, lag(x) over w as xp from o window w as (order by x)), places as (select i::bigint as grid, i / 99 as g from range(100) t(i)) "
    "select grid, round(g, 6) as x, round(case when g <= x then y else coalesce(y + (y2 - y) * (g - x) / (x2 - x), y) end, 6) as value from s, places where (g >= x and coalesce(g < x2, true)) or (xp is null and g < x)"
)
def interpolated_curve(spark, sf_dir):
    return metrics.interpolated(metrics.curves(scored(spark, sf_dir), "label", "score"), "fpr", "tpr")


SWEEP = f"{SCORED}, g as (select i::bigint as percent, i / 100 as threshold from range(10, 90) t(i)), c as (select percent, {_CELLS} from (select percent, label, score >= threshold as hit from scored, g) group by percent), sweep as (select percent, tp, fp, tn, fn, {_SCORES} from c)"


@query(f"with {SWEEP} select * from sweep")
def threshold_sweep(spark, sf_dir):
    return metrics.threshold_sweep(scored(spark, sf_dir), "label", "score")


@query(f"with {SWEEP}, b as (select percent, f1 as best from sweep order by f1 desc, percent limit 1), u as (select f1 as usual from sweep where percent = 50) select percent, best, usual, round(best - usual, 6) as gain, round(100 * (best - usual) / greatest(usual, 0.001), 6) as gain_percent from b, u")
def best_threshold(spark, sf_dir):
    return metrics.best_threshold(threshold_sweep(spark, sf_dir))


@query(f"with {SCORED} select least(floor(score * 10), 9)::bigint as bin, count(*) as n, round(avg(score), 6) as mean_score, round(avg(label), 6) as share_positive from scored group by 1")
def calibration_bins(spark, sf_dir):
    return metrics.calibration_bins(scored(spark, sf_dir), "label", "score")


@query(f"with {SCORED}, p as (select label, score, least(greatest(score, 1e-15), 1 - 1e-15) as p from scored) select round(avg((score - label) * (score - label)), 6) as brier, round(-avg(label * ln(p) + (1 - label) * ln(1 - p)), 6) as log_loss from p")
def brier_logloss(spark, sf_dir):
    return metrics.brier_logloss(scored(spark, sf_dir), "label", "score")


_FACTORS = (37, 53, 71)


def _fold_metrics(spark, sf_dir) -> DataFrame:
    """Per model (a score of its own) and fold: precision, recall, F1."""
    rows = scored(spark, sf_dir)
    own = rows.select("doc_id", "label", F.explode(F.array(*map(F.lit, _FACTORS))).alias("factor"))
    own = own.select(F.concat(F.lit("m"), "factor").alias("model"), (F.col("doc_id") % 5).alias("fold"), "label", (F.pmod(F.col("doc_id") * F.col("factor"), F.lit(101)) / 100.0 >= 0.3).cast("int").alias("hit"))
    cells = metrics.classification(metrics.confusion(own, F.col("label"), F.col("hit"), ["model", "fold"]))
    return cells.select("model", "fold", F.stack(F.lit(3), F.lit("precision"), F.col("precision"), F.lit("recall"), F.col("recall"), F.lit("f1"), F.col("f1")).alias("metric", "value"))


FOLDS = (
    f"{SCORED}, h as (select 'm' || f as model, doc_id % 5 as fold, label, ((doc_id * f) % 101) / 100.0::double >= 0.3 as hit from scored, (values (37), (53), (71)) t(f)), c as (select model, fold, {_CELLS} from h group by 1, 2), "
    f"s as (select model, fold, {_SCORES} from c), long as (select model, fold, 'precision' as metric, precision as value from s union all select model, fold, 'recall', recall from s union all select model, fold, 'f1', f1 from s)"
)
SUMMARY = f"{FOLDS}, summary as (select model, metric, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, round(min(value), 6) as min, round(max(value), 6) as max from long group by 1, 2)"


@query(f"with {SUMMARY} select * from summary")
def cv_aggregate(spark, sf_dir):
    return metrics.fold_summary(_fold_metrics(spark, sf_dir))


STABLE = "stable as (select model, metric, case when mean > 0 then std / mean else 'infinity'::double end as v from summary)"


@query(f"with {SUMMARY}, {STABLE} select model, metric, round(v, 6) as cv, round(1 / (1 + v), 6) as stability from stable")
def cv_stability(spark, sf_dir):
    return metrics.fold_stability(cv_aggregate(spark, sf_dir))


@query(f"with {SUMMARY}, {STABLE} select model, round(v, 6) as cv, row_number() over (order by round(v, 6), model) as rank from stable where metric = 'f1'")
def rank_models(spark, sf_dir):
    from pyspark.sql import Window

    own = cv_stability(spark, sf_dir).where("metric = 'f1'")
    return own.select("model", "cv", F.row_number().over(Window.orderBy("cv", "model")).cast("long").alias("rank"))


@query(f"with {SUMMARY}, f as (select model as config, mean as f1 from summary where metric = 'f1'), b as (select f1 as base from f where config = 'm37'), d as (select config, f1, round(f1 - base, 6) as delta, round(coalesce(100 * (f1 - base) / nullif(base, 0), 0), 6) as percent from f, b) select *, row_number() over (order by delta, config) as rank from d")
def ablation_delta(spark, sf_dir):
    own = cv_aggregate(spark, sf_dir).where("metric = 'f1'").select(F.col("model").alias("config"), F.col("mean").alias("f1"))
    return metrics.ablation(own, "m37")


@query(f"with {SWEEP}, s as (select percent as n, f1, lead(f1) over (order by percent) - f1 as step from sweep) select coalesce(min(n) filter (step < 0.001), max(n)) as n from s")
def elbow(spark, sf_dir):
    return metrics.elbow(threshold_sweep(spark, sf_dir).select(F.col("percent").alias("n"), "f1"), 0.001)


@query(f"with {SWEEP}, s as (select percent, (percent - lag(percent) over w) * (f1 + lag(f1) over w) / 2 as piece from sweep window w as (order by percent)) select round(coalesce(sum(piece) / nullif(max(percent) - min(percent), 0), 0), 6) as area from s")
def robustness_area(spark, sf_dir):
    return metrics.area(threshold_sweep(spark, sf_dir), "percent", "f1")


def _merged(spark, sf_dir) -> DataFrame:
    """Predictions of the merge over the pair list; labels from equal texts, the model from similarity."""
    pairs = pair_list(spark, sf_dir)
    typed = _typed(spark, sf_dir)
    truth = pairs.join(class_pairs(documents(spark, sf_dir)).withColumn("t", F.lit(1)), ["id1", "id2"], "left").select("id1", "id2", F.when(F.col("t") == 1, 1).when((F.col("id1") % 5) == 0, 3).otherwise(0).alias("label"))
    cand = minhash_similarity(spark, sf_dir).where("similarity >= 0.1").select("id1", "id2", (F.col("similarity") >= 0.3).cast("int").alias("model"))
    return clones.merged_predictions(truth, cand, typed)


MERGED = (
    f"{SIGNED.replace(DOCS + ', ', '')}, sim as (select id1, id2, floor(({_SAME}) * 10000 / {HASHES}) / 10000 as s from pairs join sig a on a.id = id1 join sig b on b.id = id2), "
    "merged as (select p.id1, p.id2, case when cp.id1 is not null then 1 when p.id1 % 5 = 0 then 3 else 0 end as label, case when t.clone_type in (1, 2) then t.clone_type when s.s >= 0.1 and s.s >= 0.3 then 3 else 0 end as prediction "
    "from pairs p left join cp on cp.id1 = p.id1 and cp.id2 = p.id2 left join typed t on t.id1 = p.id1 and t.id2 = p.id2 left join sim s on s.id1 = p.id1 and s.id2 = p.id2)"
)


@query(f"with {TYPED}, {MERGED} select * from merged")
def merged_predictions(spark, sf_dir):
    return _merged(spark, sf_dir)


@query(f"with {TYPED}, {MERGED} select label, " + ", ".join(f"count(*) filter (prediction = {x}) as predicted_{x}" for x in range(4)) + " from merged group by label")
def multiclass_confusion(spark, sf_dir):
    return clones.pivoted_confusion(_merged(spark, sf_dir), [0, 1, 2, 3])


@query(
    f"with {TYPED}, {MERGED}, k as (select unnest([1, 2]) as clone_type), c as (select clone_type, count(*) filter (label = clone_type and prediction = clone_type) as tp, count(*) filter (label <> clone_type and prediction = clone_type) as fp, count(*) filter (label = clone_type and prediction <> clone_type) as fn from merged, k group by 1) "
    "select clone_type, tp, fp, fn, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision from c"
)
def rule_report(spark, sf_dir):
    return clones.rule_report(_merged(spark, sf_dir))


@query(f"with {DOCS}, c as (select length(text) as n from docs) select least(floor(n / 1000.0), 19)::bigint as bin, count(*) as n from c where n between 0 and 20000 group by 1")
def length_histogram(spark, sf_dir):
    from ..sources.writers import histogram

    return histogram(documents(spark, sf_dir).select(F.length("text").alias("len")), "len", 0, 20000, 20)


# --- experiments -------------------------------------------------------------------------------

_TUNE = (
    "t as (select count(*) filter (quality = 1) as p, count(*) filter (quality <> 1) as n from labels), g as (select h as n_hashes, b as n_bands, k as shingle_k, h // b as rows_per_band from range(64, 256, 64) x(h), range(2, 32, 2) y(b), range(3, 5) z(k) where h % b = 0), "
    "a as (select *, pow(1 / n_bands, 1 / rows_per_band) as threshold, floor(p * 0.95)::bigint as tp from g, t), b as (select *, floor(n * ((1 - threshold) * 0.3))::bigint as fp from a), "
    "c as (select *, p - tp as fn, n - fp as tn, tp / greatest(p, 1) as recall, tp / greatest(tp + fp, 1) as precision, 1 - (tp + fp) / greatest(p + n, 1) as reduction, (p + n) * 0.001 * (n_hashes / 128) * (n_bands / 16) as seconds from b), "
    "d as (select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1, 0.4 * recall + 0.3 * precision + 0.3 / (1 + seconds) as balanced from c)"
)
_TUNED = ["threshold", "recall", "precision", "reduction", "seconds", "f1", "balanced"]
_COUNTS = ["n_hashes", "n_bands", "shingle_k", "rows_per_band", "tp", "fp", "fn", "tn"]
_TUNE_COLUMNS = ", ".join([*_COUNTS, *(f"round({c}, 6)::double as {c}" for c in _TUNED)])


def _sweep(spark, sf_dir) -> DataFrame:
    n = table(spark, sf_dir, "labels").agg(F.count(F.when(F.col("quality") == 1, 1)).alias("p"), F.count(F.when(F.col("quality") != 1, 1)).alias("n")).first()
    return tuning.sweep(spark, n.p, n.n)


def _rounded(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*_COUNTS, *(F.round(c, 6).alias(c) for c in _TUNED), *more)


@query(f"with {_TUNE} select {_TUNE_COLUMNS} from d")
def lsh_simulation_sweep(spark, sf_dir):
    return _rounded(_sweep(spark, sf_dir))


@query(
    f"with {_TUNE}, e as (select *, case when recall >= 0.9 and precision >= 0.5 and seconds <= 5 then 1 when recall >= 0.81 then 2 end as tier from d), f as (select * from e where tier = (select min(tier) from e)), h as (select *, row_number() over (order by f1 desc, n_hashes, n_bands, shingle_k) as place from f) select {_TUNE_COLUMNS}, tier, place from h where place <= 4"
)
def lsh_recommend(spark, sf_dir):
    return _rounded(tuning.recommend(_sweep(spark, sf_dir)), "tier", "place")


@query(f"with {_TUNE} select {_TUNE_COLUMNS} from d order by f1 desc, d.n_hashes, d.n_bands, d.shingle_k limit 1")
def lsh_best_f1(spark, sf_dir):
    return _rounded(tuning.best(_sweep(spark, sf_dir), F.col("f1")))


@query(
    f"with {KEYED}, {PAIRS} " + " union all ".join(f"(select {b} as bands, count(*) as candidates from pairs join keyed a on a.id = id1 join keyed b on b.id = id2 where {' or '.join(f'a.bands[{i}] = b.bands[{i}]' for i in range(1, b + 1))})" for b in (4, 8, 16))
)
def lsh_ablation(spark, sf_dir):
    """Candidates of the pair list by the number of bands used, from one signature table."""
    keyed = _keyed(spark, sf_dir)
    full = clones.attach(pair_list(spark, sf_dir), keyed, ["bands"])
    first = F.array_position(F.zip_with("bands1", "bands2", lambda x, y: x == y), True)
    hit = [F.count(F.when((first > 0) & (first <= b), 1)).alias(str(b)) for b in (4, 8, 16)]
    return full.agg(*hit).select(F.stack(F.lit(3), *(x for b in (4, 8, 16) for x in (F.lit(b), F.col(f"`{b}`")))).alias("bands", "candidates"))


# --- neighbours and models ---------------------------------------------------------------------


@query(
    "with v as (select vec_id as id, embedding::double[] as e from embeddings where vec_id is not null and embedding is not null), d as (select q.id as query_id, v.id, list_distance(q.e, v.e) as distance from v q, v where q.id % 50 = 0 and v.id <> q.id), r as (select *, row_number() over (partition by query_id order by distance, id) as place from d) select query_id, place, id, round(distance, 6) as distance from r where place <= 7"
)
def knn(spark, sf_dir):
    """The seven nearest vectors of every query, the rows whose id is divisible by 50."""
    from ..operators.neighbours import nearest

    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return nearest(own.where("id % 50 = 0"), own, 7).withColumn("distance", F.round("distance", 6))


QUALITY = ["words", "distinct_share", "mean_length", "mark_share", "upper_share", "digit_share"]


def quality_features(spark, sf_dir) -> DataFrame:
    """Labelled documents with measures of their text, and a fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    n, chars = F.greatest(F.size("w"), F.lit(1)), F.greatest(F.length("text"), F.lit(1))
    kept = lambda p: (F.length("text") - F.length(F.regexp_replace("text", p, ""))) / chars
    own = docs.withColumn("w", words).select(
        "doc_id", F.size("w").cast("double").alias("words"), (F.size(F.array_distinct("w")) / n).alias("distinct_share"), (chars / n).alias("mean_length"),
        kept(r"[^\p{L}\p{N}\s]").alias("mark_share"), kept(r"\p{Lu}").alias("upper_share"), kept("[0-9]").alias("digit_share"),
    )
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))
    return splits.folds(own.join(labels.where("label is not null"), "doc_id"), "label", ["doc_id"], 3)


@query()
def model_cross_validation(spark, sf_dir):
    """Three-fold metrics of all models."""
    from . import models

    return models.cross_validated(quality_features(spark, sf_dir).cache(), QUALITY, k=3, key="doc_id")


@query()
def model_selection(spark, sf_dir):
    """Models cross-validated on two folds' rows, the best of them refit, and its metrics on the third fold with labels 0 and 3."""
    from . import models

    own = quality_features(spark, sf_dir).cache()
    train = splits.folds(own.where("fold <> 2").drop("fold"), "label", ["doc_id"], 3)
    names = ("forest", "logistic", "knn")
    _, best, model = models.trained(train, QUALITY, names, k=3, key="doc_id")
    test = own.where("fold = 2")
    scored = models.voted(train, test, QUALITY, "doc_id") if model is None else models.scored(model, test, QUALITY)
    return models.tested(scored.withColumn("label", F.col("label") * 3)).select(F.lit(best).alias("model"), "*")


@query()
def model_elimination(spark, sf_dir):
    from . import models

    rows = models.eliminated(quality_features(spark, sf_dir).cache(), QUALITY, (2, 4, 6), k=3)
    return spark.createDataFrame([(r["n"], ",".join(r["features"]), r["f1"], r["accuracy"]) for r in rows], "n long, features string, f1 double, accuracy double")


@query()
def model_calibration(spark, sf_dir):
    from . import models

    own = quality_features(spark, sf_dir).cache()
    return models.calibration_report(models.out_of_fold(own, QUALITY, "logistic", 3).select("fold", "label", "score"), 3)


@query()
def model_robustness(spark, sf_dir):
    from . import analysis, models

    own = quality_features(spark, sf_dir).cache()
    model = models.fitted(own.where("fold <> 0"), QUALITY, "forest")
    parts = [analysis.robustness(model, own.where("fold = 0"), QUALITY, kind).select(F.lit(kind).alias("kind"), "*") for kind in analysis.PERTURBATIONS]
    return reduce(DataFrame.union, parts)


@query()
def model_importance_stability(spark, sf_dir):
    from . import analysis

    return analysis.importance_stability(quality_features(spark, sf_dir).cache(), QUALITY, k=3)


@query()
def feature_ablation(spark, sf_dir):
    from . import analysis

    return analysis.one_feature_out(quality_features(spark, sf_dir).cache(), QUALITY, k=3)


def _detector(spark, sf_dir) -> tuple[DataFrame, object, list[str]]:
    """Labelled test pairs, a model fit on the other pairs, and its features, none of which the label is made of.

    A pair is a modified copy if its common subsequence is long; the features that measure it
    or are it under another name take no part.  Half of the pairs, by md5 of their ids, train.
    """
    from . import models

    features = _features(spark, sf_dir, False)
    names = [c for c in features.columns if c not in ("id1", "id2", "lex_lcs_ratio", "lex_levenshtein_ratio")]
    rows = pair_features.sanitized(features, [*names, "lex_lcs_ratio"]).withColumn("label", (F.col("lex_lcs_ratio") >= 0.75).cast("int"))
    trains = F.substring(splits.order_key(["id1", "id2"]), 1, 1) < "8"
    model = models.fitted(rows.where(trains), names, "forest", trees=DETECTOR_TREES)
    return rows.where(~trains).select("id1", "id2", (F.col("label") * 3).alias("label")), model, names


#: Trees of the forest that the detection queries fit.
DETECTOR_TREES = 5


@query()
def detection(spark, sf_dir):
    """The detection plan over the test half of the pairs of neighbouring turns."""
    from . import detection as plan

    pairs, model, names = _detector(spark, sf_dir)
    return plan.detected(pairs, turns(spark, sf_dir), model, names)


@query(f"with {_TUNE} select n_bands, " + ", ".join(f"round(min_by(case when n_hashes = {h} then precision end, case when n_hashes = {h} then shingle_k end), 6)::double as h{h}" for h in (64, 128, 192)) + " from d group by n_bands")
def lsh_heatmap(spark, sf_dir):
    own = tuning.heatmap(_sweep(spark, sf_dir), "precision", [64, 128, 192])
    return own.select("n_bands", *(F.round(f"h{h}", 6).alias(f"h{h}") for h in (64, 128, 192)))


@query(f"with {SCORED}, w as (select doc_id, " + ", ".join(f"(((doc_id * {f}) % 101) / 100.0::double >= 0.3)::int as m{f}" for f in _FACTORS) + " from scored) " + " union all ".join(f"select 'm{a}' as model1, 'm{b}' as model2, round(corr(m{a}, m{b}), 6) as r from w" for i, a in enumerate(_FACTORS) for b in _FACTORS[i + 1 :]))
def prediction_correlation(spark, sf_dir):
    rows = scored(spark, sf_dir).select("doc_id", F.explode(F.array(*map(F.lit, _FACTORS))).alias("factor"))
    own = rows.select(F.col("doc_id").alias("id"), F.concat(F.lit("m"), "factor").alias("model"), (F.pmod(F.col("doc_id") * F.col("factor"), F.lit(101)) / 100.0 >= 0.3).cast("int").alias("prediction"))
    return metrics.prediction_correlation(own, [f"m{f}" for f in _FACTORS])


@query(
    f"with {SIGNED}, {PAIRS}, total as (select count(*) as n from pairs), k as (select count(*) as t from cp), "
    + ", ".join(
        f"hit{b} as (select id1, id2 from pairs join sig a on a.id = id1 join sig b on b.id = id2 where " + " or ".join("(" + " and ".join(f"a.m{i * (48 // b) + r} = b.m{i * (48 // b) + r}" for r in range(48 // b)) + ")" for i in range(b)) + ")"
        for b in (8, 12)
    )
    + " "
    + " union all ".join(
        f"select 48 as n_hashes, {b} as n_bands, n as pairs_before, c as pairs_after, t as true_pairs, r as true_retained, case when n > 0 then round(1 - c / n, 6) else 0 end as reduction, coalesce(round(r / nullif(t, 0), 6), 0) as candidate_recall, coalesce(round(r / nullif(c, 0), 6), 0) as candidate_precision from total, k, (select count(*) as c, count(cp.id1) as r from hit{b} left join cp using (id1, id2))"
        for b in (8, 12)
    )
)
def lsh_empirical_sweep(spark, sf_dir):
    own = documents(spark, sf_dir)
    return tuning.empirical(pair_list(spark, sf_dir), class_pairs(own), clones.word_shingles(own, SHINGLE), (48,), (8, 12))


@query()
def pipeline_ablation(spark, sf_dir):
    from . import detection as plan

    pairs, model, names = _detector(spark, sf_dir)
    return plan.ablation(pairs, turns(spark, sf_dir), model, names)


# --- the feature table over given records, and steps of experiments over given tables -----------

_GIVEN = (
    "g as (select l_orderkey as id, list((l_partkey % 12)::int order by l_linenumber, l_partkey % 12) as t, (max(l_linenumber) - 1)::bigint as depth, (count(*) * 2)::bigint as nodes, sum(l_quantity)::bigint as lines, (sum(l_suppkey) * 3)::bigint as chars from lineitem group by l_orderkey), "
    "r as (select id, t, len(t)::bigint as n, depth, nodes, list_transform(range(0, 12), lambda c: len(list_filter(t, lambda x: x = c))) as h, list_transform(range(1, len(t)), lambda i: t[i] * 256 + t[i + 1]) as b, (1 + len(list_filter(t, lambda x: x in (0, 2))))::bigint as cc, lines, chars from g), "
    "p as (select a.id as id1, b.id as id2, " + ", ".join(f"{s}.{c} as {c}{i}" for s, i in (("a", 1), ("b", 2)) for c in ("t", "n", "depth", "nodes", "h", "b", "cc", "lines", "chars")) + " from r a join r b on b.id = a.id + 1), "
    "w(id1, id2, t1, t2, i, d) as (select id1, id2, t1, t2, 0, list_transform(range(0, len(t2) + 1), lambda j: 0) from p union all "
    "select id1, id2, t1, t2, i + 1, list_transform(range(0, len(t2) + 1), lambda j: case when j = 0 then 0 else list_max(list_transform(range(1, j + 1), lambda k: greatest(d[k + 1], case when t2[k] = t1[i + 1] then d[k] + 1 else 0 end))) end) from w where i < len(t1)), "
    "l as (select id1, id2, d[len(t2) + 1] as lcs from w where i = len(t1)), "
    "f as (select p.*, lcs, array_to_string(t1, ' ') as s1, array_to_string(t2, ' ') as s2, len(list_filter(b1, lambda x: list_contains(b2, x))) as bi, len(list_filter(t1, lambda x: x = 1)) as i1, len(list_filter(t2, lambda x: x = 1)) as i2, len(list_distinct(list_concat(t1, t2))) as u, len(list_intersect(t1, t2)) as x from p join l using (id1, id2))"
)
_LCS = "2 * lcs / (n1 + n2)"
_GIVEN_SQL = {
    "lex_levenshtein_ratio": "1 - levenshtein(s1, s2) / greatest(length(s1), length(s2))", "lex_token_set_ratio": "0", "lex_sequence_match_ratio": "x / u",
    "lex_jaccard_tokens": "2 * x / (len(list_distinct(t1)) + len(list_distinct(t2)))", "lex_dice_tokens": _LCS, "lex_lcs_ratio": _LCS, "lex_char_jaccard": "jaccard(s1, s2)",
    "struct_ast_hist_cosine": f"coalesce({_DOT.format('h1', 'h2')} / nullif(sqrt({_DOT.format('h1', 'h1')}) * sqrt({_DOT.format('h2', 'h2')}), 0), 0)",
    "struct_bigram_cosine": "case when len(b1) = 0 or len(b2) = 0 then 0 else bi / (len(b1) + len(b2) - bi) end",
    "struct_depth_diff": "abs(depth1 - depth2)", "struct_depth_ratio": _R.format("depth1", "depth2"), "struct_node_count1": "nodes1", "struct_node_count2": "nodes2",
    "struct_node_ratio": _R.format("nodes1", "nodes2"), "struct_node_diff": "abs(nodes1 - nodes2)", "quant_token_ratio": _R.format("n1", "n2"),
    "quant_line_delta": "abs(lines1 - lines2) / greatest(lines1, lines2, 1)", "quant_identifier_ratio": "coalesce(2 * least(i1, i2) / nullif(i1 + i2, 0), 1)",
    "quant_cc1": "cc1", "quant_cc2": "cc2", "quant_cc_ratio": _R.format("cc1", "cc2"), "quant_cc_diff": "abs(cc1 - cc2)", "quant_lines1": "lines1", "quant_lines2": "lines2",
    "quant_chars1": "chars1", "quant_chars2": "chars2", "quant_char_ratio": "least(chars1, chars2) / greatest(chars1, chars2, 1)",
}


def given_records(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Token records and sizes of snippets as given tables: an order is a snippet, its lines are the tokens."""
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_partkey") % 12).cast("int").alias("t")))).alias("s"),
        (F.max("l_linenumber") - 1).cast("long").alias("max_depth"), (F.count("*") * 2).alias("node_count"), F.sum("l_quantity").cast("long").alias("lines"), (F.sum("l_suppkey") * 3).cast("long").alias("chars"),
    )
    t, n = F.col("s.t"), F.size("s")
    two = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.element_at(t, i) * 256 + F.element_at(t, F.least(i + 1, n)))).otherwise(F.array().cast("array<int>"))
    ast = F.struct("max_depth", "node_count", T.count_categories(t).alias("histogram"), two.alias("bigrams"), T.cyclomatic(t).alias("cyclomatic_complexity"))
    records = own.select("id", t.alias("token_ids"), n.cast("long").alias("token_count"), ast.alias("ast"))
    return records, own.select("id", "lines", "chars")


@query(f"with recursive {_GIVEN} select id1, id2, " + ", ".join(f"round(({v})::double, 6) as {k}" for k, v in _GIVEN_SQL.items()) + " from f")
def pair_features_given(spark, sf_dir):
    """All 27 features over given token records."""
    records, sizes = given_records(spark, sf_dir)
    pairs = neighbours(records, 1)
    out = pair_features.pair_features(pairs, pair_features.described(records, sizes), parity=True)
    return out.select("id1", "id2", *(F.round(c, 6).alias(c) for c in out.columns if c not in ("id1", "id2")))


@query("with p as (select distinct least(l_partkey, l_suppkey) as id1, greatest(l_partkey, l_suppkey) as id2 from lineitem where l_linenumber = 1), t as (select distinct least(l_partkey, l_suppkey) as id1, greatest(l_partkey, l_suppkey) as id2, 3 as label from lineitem where l_linenumber = 2) select id1, id2, id1 + id2 as f, label from p join t using (id1, id2)")
def labelled_features(spark, sf_dir):
    own = clones.canonical(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id1"), F.col("l_suppkey").alias("id2"), "l_linenumber"))
    side = lambda k: own.where(F.col("l_linenumber") == k).select("id1", "id2").distinct()
    return splits.with_labels(side(1).withColumn("f", F.col("id1") + F.col("id2")), side(2).withColumn("label", F.lit(3)))


@query(f"with {TYPED} select id1, id2 from typed where clone_type = 0")
def remaining_pairs(spark, sf_dir):
    return _typed(spark, sf_dir).where("clone_type = 0").select("id1", "id2")


@query(f"with {TYPED}, {MERGED}, c as (select {_CELLS} from (select (label > 0)::int as label, prediction > 0 as hit from merged)) select tp, fp, tn, fn, {_SCORES}, coalesce(tp / nullif(tp + fn, 0), 0) < 0.1 as low_recall from c")
def detection_report(spark, sf_dir):
    from . import detection as plan

    return plan.report(_merged(spark, sf_dir))


_DRAWN = random.Random(42).sample(_NUMBERS, len(_NUMBERS) // 2)


@query("select l_orderkey, l_linenumber, " + ", ".join("0.0::double as " + c if c in _DRAWN else f"{c}::double as {c}" for c in _NUMBERS) + " from lineitem")
def masked_features(spark, sf_dir):
    from . import analysis

    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(F.col(c).cast("double").alias(c) for c in _NUMBERS))
    return analysis.masked(own, _NUMBERS, 0.5)


def _signs() -> list[int]:
    rng = random.Random(42)
    return [rng.choice((-1, 1)) for _ in _NUMBERS]


@query("select l_orderkey, l_linenumber, " + ", ".join(f"round({c}::double + {s} * 0.25::double * abs({c}::double), 6) as {c}" for c, s in zip(_NUMBERS, _signs(), strict=True)) + " from lineitem")
def shifted_features(spark, sf_dir):
    from . import analysis

    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(F.col(c).cast("double").alias(c) for c in _NUMBERS))
    return analysis.shifted(own, _NUMBERS, 0.25).select("l_orderkey", "l_linenumber", *(F.round(c, 6).alias(c) for c in _NUMBERS))


_VOTED = f"{SCORED}, v as (select doc_id as id, label, 'm' || f as model, (((doc_id * f) % 101) / 100.0::double >= 0.3)::int as prediction from scored, (values (37), (53), (71)) t(f))"


@query(f"with {_VOTED}, c as (select id, round(avg(prediction))::int as common from v group by id) select model, round(avg((prediction = label)::int), 6) as accuracy, round(avg((prediction = common)::int), 6) as agreement from v join c using (id) group by model")
def prediction_stability(spark, sf_dir):
    from . import analysis

    rows = scored(spark, sf_dir).select("doc_id", "label", F.explode(F.array(*map(F.lit, _FACTORS))).alias("factor"))
    own = rows.select(F.col("doc_id").alias("id"), "label", F.concat(F.lit("m"), "factor").alias("model"), (F.pmod(F.col("doc_id") * F.col("factor"), F.lit(101)) / 100.0 >= 0.3).cast("int").alias("prediction"))
    return analysis.prediction_stability(own)


@query("with r as (select o_orderpriority as config, count(*)::double as seconds from orders group by 1), b as (select seconds as base from r where config = '1-URGENT') select config, seconds, base - seconds as saved, round(coalesce((base - seconds) / nullif(base, 0), 0), 6) as reduction, round(coalesce(base / nullif(seconds, 0), 0), 6) as speedup from r, b")
def runtime_ablation(spark, sf_dir):
    from . import analysis

    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("config")).agg(F.count("*").cast("double").alias("seconds"))
    return analysis.runtime_ablation(rows, "1-URGENT").select("config", "seconds", "saved", F.round("reduction", 6).alias("reduction"), F.round("speedup", 6).alias("speedup"))


_STAGES = "s as (select o_orderpriority as stage, count(*)::double as seconds, max(o_totalprice)::double as peak_mb from orders group by 1)"


@query(f"with {_STAGES} select sum(seconds) as seconds, max(peak_mb) as peak_mb, max_by(stage, peak_mb) as largest_stage, max_by(stage, seconds) as slowest_stage from s")
def memory_totals(spark, sf_dir):
    from . import analysis

    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("stage")).agg(F.count("*").cast("double").alias("seconds"), F.max("o_totalprice").cast("double").alias("peak_mb"))
    return analysis.Profile.totals(rows)


_LEVELS = f"{SCORED}, h as (select 'm' || f as model, i as level, label, ((doc_id * f) % 101) / 100.0::double >= i / 10.0::double as hit from scored, (values (37), (53), (71)) t(f), range(0, 6) r(i)), c as (select model, level, {_CELLS} from h group by 1, 2), curves as (select model, level, {_SCORES} from c)"


@query(f"with {_LEVELS}, s as (select model, level, (level - lag(level) over w) * (f1 + lag(f1) over w) / 2 as piece from curves window w as (partition by model order by level)), a as (select model, round(coalesce(sum(piece) / nullif(max(level) - min(level), 0), 0), 6) as robustness from s group by model) select model, robustness, row_number() over (order by robustness desc, model) as rank from a")
def robustness_ranking(spark, sf_dir):
    from . import analysis

    rows = scored(spark, sf_dir).select("doc_id", "label", F.explode(F.array(*map(F.lit, _FACTORS))).alias("factor")).select("*", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("level"))
    own = rows.select(F.concat(F.lit("m"), "factor").alias("model"), "level", "label", (F.pmod(F.col("doc_id") * F.col("factor"), F.lit(101)) / 100.0 >= F.col("level") / 10.0).cast("int").alias("hit"))
    return analysis.robustness_ranking(metrics.classification(metrics.confusion(own, F.col("label"), F.col("hit"), ["model", "level"])))


_IMPORTANCE = "i as (select l_linenumber % 5 as fold, l_returnflag as feature, round(avg(l_quantity)::double, 6) as importance from lineitem group by 1, 2)"


@query(f"with {_IMPORTANCE}, k as (select *, row_number() over (partition by fold order by importance desc, feature) as rank from i), a as (select feature, avg(importance) as mean, stddev_pop(importance) as std, min(importance) as min, max(importance) as max, avg(rank) as rank_mean, stddev_pop(rank) as rank_std from k group by feature) select feature, round(mean, 6) as mean, round(std, 6) as std, min, max, round(rank_mean, 6) as rank_mean, round(rank_std, 6) as rank_std, round(std / mean, 6) as cv, case when std / mean < 0.5 then 'stable' when std / mean > 1 then 'unstable' else 'medium' end as verdict from a")
def importance_ranks(spark, sf_dir):
    from . import analysis

    own = table(spark, sf_dir, "lineitem").groupBy((F.col("l_linenumber") % 5).alias("fold"), F.col("l_returnflag").alias("feature")).agg(F.round(F.avg("l_quantity").cast("double"), 6).alias("importance"))
    out = analysis.importance_ranks(own)
    return out.select("feature", *(F.round(c, 6).alias(c) for c in ("mean", "std")), "min", "max", *(F.round(c, 6).alias(c) for c in ("rank_mean", "rank_std", "cv")), "verdict")


_TRAIN = (
    f"s as (select o_orderkey as id1, o_orderkey + 1 as id2, {_SET_SQL} as clone_set from orders), t as (select id1, id2, clone_set, case when clone_set in ('type3', 'type4') then 3 when clone_set in ('type5', 'nonclone') then 0 end as label from s), "
    "u as (select *, row_number() over (partition by label order by md5(concat_ws('-', id1, id2, '42')), id1, id2) as rank, count(*) over (partition by label) as size from t where label is not null), v as (select id1, id2, clone_set, (label = 3)::int as label from u where rank > floor(size * 0.3 + 0.5)), "
    "x as (select *, row_number() over (partition by label order by md5(concat_ws('-', id1, id2, '42')), id1, id2) as rank, count(*) over (partition by label) as size from v)"
)


@query(f"with {_TRAIN} select id1, id2, clone_set, label from x where rank <= (select min(size) from x)")
def training_pairs(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id1"), (F.col("o_orderkey") + 1).alias("id2"), F.element_at(F.array(*map(F.lit, _SETS)), (F.col("o_orderkey") % 7 + 1).cast("int")).alias("clone_set"))
    return splits.datasets(own, ["id1", "id2"])[0]


# the 64-bit family over hashed token windows

_FNV = "14695981039346656037::uhugeint"
for _j in range(SHINGLE):
    for _shift in (0, 8, 16, 24):
        _FNV = f"((xor({_FNV}, ((k[i + {_j}] >> {_shift}) & 255)::uhugeint) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint)"
_SIGNED64 = "(case when {0} >= 9223372036854775808::uhugeint then ({0}::hugeint - 18446744073709551616::hugeint) else {0}::hugeint end)::bigint"
_WINDOWS64 = f"{TALK}, z as (select id, unnest(list_transform(range(1, len(k) - {SHINGLE} + 2), lambda i: {_FNV})) as x from tokens where len(k) >= {SHINGLE})"


@query(f"with {_WINDOWS64} select id, {_SIGNED64.format('x')} as shingle from z")
def token_shingles(spark, sf_dir):
    """Hashed windows of tokens, as signed 64-bit patterns, repeats included."""
    return normalize.tokenized(turns(spark, sf_dir)).select("id", F.explode(H.fnv_shingles(F.col("tokens"), SHINGLE)).alias("shingle"))


_MINIMA = ", ".join(f"min(((x * {a}::uhugeint + {b}::uhugeint) % 18446744073709551616::uhugeint) % {H.PRIME64}::uhugeint) as u{i}" for i, (a, b) in enumerate(H.coefficients64(8)))


@query(f"with {_WINDOWS64}, m as (select id, {_MINIMA} from z group by id) select id, " + ", ".join(f"{_SIGNED64.format(f'u{i}')} as m{i}" for i in range(8)) + " from m")
def minhash_signatures64(spark, sf_dir):
    """The first eight minima of the 64-bit family over the hashed token windows."""
    return clones.signatures64(token_shingles(spark, sf_dir), 8)
