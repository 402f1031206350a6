"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Text becomes tokens (runs of letters and digits). A token with a digit becomes `#`, a unit after a number
`%`, a capitalised word `@`, any other its lower case. Windows of WINDOW template tokens with at least LITERAL
that are no placeholders are hash-joined between documents and benchmark items. Matches of one item on one
diagonal (place in the document minus place in the item) are counted; where they cover COVER of the item's
windows, the slots inside the windows that match are checked: on that diagonal, each value of a slot must stand for one
value in the document throughout. What passes is a leak; it is re-parameterised if a value differs. What follows a
passage's end or an inserted word does not count against it. With joined, a number with separators and
a run of capitalised words are one token each, so that a value with another count of pieces shifts nothing; the query
and LEAKS_SQL take the pieces apart, the pipeline searches both ways.

Results for unusual input: null or empty texts, and items or texts under WINDOW tokens: no leak; items
without a window of LITERAL plain tokens can't be searched; very long texts: whole; repeated rows of documents or items,
and different texts of one id: reported once for each doc_id and item_id, with the largest counts; several diagonals of
an item that cover enough: the same; null doc_id: reported with its null; null item_id: not searched; empty tables give an
empty result; other columns of the inputs, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofeat.llm._common import fit_for_broadcast, store

WINDOW, LITERAL, COVER = 8, 5, 0.5

# The units that may follow a number.
UNITS = "km m cm mm kg g mg lb lbs oz l ml s h min ms hz km2 mph kmh ft in mi yd usd eur gbp dollars euros cents percent meters metres miles kilometers grams kilograms liters litres seconds minutes hours days weeks months years degrees"


#: Stands between the pieces of one value.
JOINT = "\ue000"


def words(text: Column, joined: bool = False) -> Column:
    """The text's tokens, one blank between them; with joined, the pieces of a value are one token."""
    if joined:
        # what stands before a joint is matched, not looked behind at: that is tried at every sign of the text
        text = F.regexp_replace(F.regexp_replace(text, JOINT, " "), "(\\p{N})(?:[.,:/'\u2019]|[ \u00a0\u202f](?=\\p{N}{3}(?!\\p{N})))(?=\\p{N})", f"$1{JOINT}")
        text = F.regexp_replace(text, "(?<![\\p{L}\\p{N}])(\\p{Lu}\\p{Ll}+)[ -](?=\\p{Lu}\\p{Ll}+(?![\\p{L}\\p{N}]))", f"$1{JOINT}")
        return F.trim(F.regexp_replace(text, f"[^\\p{{L}}\\p{{N}}{JOINT}]+", " "))
    return F.trim(F.regexp_replace(text, "[^\\p{L}\\p{N}]+", " "))


def template(spaced: Column) -> Column:
    """Tokens with typed placeholders, of the same number."""
    t = F.regexp_replace(spaced, f"(?<![^ ])\\p{{Lu}}\\p{{Ll}}+(?:{JOINT}\\p{{Lu}}\\p{{Ll}}+)*(?![^ ])", "@")
    t = F.regexp_replace(t, "(?<![^ ])[^ ]*\\p{N}[^ ]*", "#")
    return F.regexp_replace(F.lower(t), f"(?<=(?<![^ ])# )(?:{'|'.join(UNITS.split())})(?![^ ])", "%")


def bound(value: Column, use) -> Column:
    """use(value), with value computed once a row: a lambda's argument is not substituted into its body."""
    return F.get(F.transform(F.array(value), use), 0)


def window_keys(tokens: Column) -> Column:
    """A hash for each window of WINDOW tokens; null for fewer tokens."""
    last = lambda h: F.size(h) - (WINDOW - 1)
    keys = lambda h: F.when(last(h) >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last(h), F.lit(1))), lambda i: F.xxhash64(F.slice(h, i, WINDOW))))
    return bound(F.transform(tokens, lambda x: F.xxhash64(x)), keys)


def find_leaks(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, joined: bool = False, carry: bool = False) -> DataFrame:
    """doc_id, item_id, n_windows, item_windows, n_slots, reparameterised of every leak.

    carry: by row rather than by doc_id, with uid, a hash of the row's doc_id and text.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text").cast("string"), joined).alias("i_words")).where("item_id is not null and i_words <> ''").distinct()
    items = items.withColumn("i_uid", F.xxhash64("item_id", "i_words")).withColumn("i_tokens", F.split(template(F.col("i_words")), " "))
    windows = items.select("item_id", "i_uid", "i_tokens", F.posexplode(window_keys(F.col("i_tokens"))).alias("q", "w"))
    plain = F.size(F.filter(F.slice("i_tokens", F.col("q") + 1, WINDOW), lambda x: ~x.isin("#", "@", "%"))) >= LITERAL
    windows = store(windows.where(plain).select("item_id", "i_uid", "q", "w"), "windows")
    sizes = windows.groupBy("i_uid").agg(F.count(F.lit(1)).alias("item_windows"))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").withColumn("uid", F.xxhash64("doc_id", "text"))
    tokens = rows.select("uid", "doc_id", F.split(template(words(F.col("text"), joined)), " ").alias("tokens"))
    every = tokens.select("uid", "doc_id", F.posexplode(window_keys(F.col("tokens"))).alias("p", "w"))
    diagonals = every.join(fit_for_broadcast(windows), "w").groupBy("uid", "doc_id", "item_id", "i_uid", (F.col("p") - F.col("q")).alias("delta"))
    # at most an item's windows in a set
    hits = diagonals.agg(F.collect_set("q").alias("matched")).withColumn("n_windows", F.size("matched").cast("long"))
    near = store(hits.join(sizes, "i_uid").where(F.col("n_windows") >= F.lit(cover) * F.col("item_windows")), "near")

    # the slots of these few, from both texts: the corpus is not shuffled for them
    texts_ = rows.join(fit_for_broadcast(near.select("uid").distinct()), "uid", "left_semi").select("uid", words(F.col("text"), joined).alias("words")).distinct()
    found = items.join(near.select("i_uid").distinct(), "i_uid", "left_semi").select("i_uid", "i_words", "i_tokens")
    both = texts_.join(near, "uid").join(found, "i_uid")
    texts = F.struct(F.split("words", " ").alias("d"), F.split("i_words", " ").alias("v"), F.col("i_tokens").alias("t"), F.col("delta").alias("delta"), F.col("matched").alias("matched"))

    def of_slots(x: Column) -> Column:
        places = F.array_distinct(F.flatten(F.transform(x.matched, lambda q: F.sequence(q, q + (WINDOW - 1)))))
        inside = F.filter(places, lambda i: F.get(x.t, i).isin("#", "@", "%") & (i + x.delta >= 0) & (i + x.delta < F.size(x.d)))
        return F.transform(inside, lambda i: F.struct(F.get(x.v, i).alias("mine"), F.get(x.d, (i + x.delta).cast("int")).alias("theirs")))

    row = ["uid", "doc_id"] if carry else ["doc_id"]
    slots = both.select(*row, "item_id", "n_windows", "item_windows", bound(texts, of_slots).alias("slots"))
    pairs = F.array_distinct("slots")
    checked = slots.where(F.size(pairs) == F.size(F.array_distinct(F.transform(pairs, lambda s: s.mine))))
    checked = checked.withColumn("n_slots", F.size("slots").cast("long")).withColumn("reparameterised", F.exists("slots", lambda s: s.mine != s.theirs))
    best = checked.groupBy(*row, "item_id").agg(
        F.max("n_windows").alias("n_windows"), F.max("item_windows").alias("item_windows"), F.max("n_slots").alias("n_slots"), F.min("reparameterised").alias("reparameterised")
    )
    return best.select(*row, "item_id", F.col("n_windows").cast("long").alias("n_windows"), F.col("item_windows").cast("long").alias("item_windows"), "n_slots", "reparameterised")


_TEMPLATE_SQL = """list_transform({x}, lambda t, i: CASE
    WHEN regexp_matches(t, '\\p{{N}}') THEN '#'
    WHEN regexp_full_match(t, '\\p{{Lu}}\\p{{Ll}}+') THEN '@'
    WHEN i > 1 AND regexp_matches({x}[i - 1], '\\p{{N}}') AND list_contains(string_split('{units}', ' '), lower(t)) THEN '%'
    ELSE lower(t) END)"""

#: The same leaks in DuckDB's SQL.
LEAKS_SQL = f"""
WITH it0 AS (SELECT DISTINCT item_id, string_split(trim(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS v FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
it AS (SELECT item_id, v, {_TEMPLATE_SQL.format(x='v', units=UNITS)} AS t FROM it0),
iw AS (SELECT item_id, v, t, unnest(generate_series(1, len(t) - {WINDOW - 1})) AS q FROM it WHERE len(t) >= {WINDOW}),
iwin AS (SELECT item_id, v, q, array_to_string(t[q:q + {WINDOW - 1}], ' ') AS w FROM iw
  WHERE len(list_filter(t[q:q + {WINDOW - 1}], lambda x: x NOT IN ('#', '@', '%'))) >= {LITERAL}),
isz AS (SELECT item_id, v, count(*) AS item_windows FROM iwin GROUP BY item_id, v),
d0 AS (SELECT DISTINCT doc_id, string_split(trim(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS d FROM documents WHERE text IS NOT NULL),
dt AS (SELECT doc_id, d, {_TEMPLATE_SQL.format(x='d', units=UNITS)} AS t FROM d0),
dp AS (SELECT doc_id, d, t, unnest(generate_series(1, len(t) - {WINDOW - 1})) AS p FROM dt WHERE len(t) >= {WINDOW}),
dwin AS (SELECT doc_id, d, p, array_to_string(t[p:p + {WINDOW - 1}], ' ') AS w FROM dp),
hit0 AS (SELECT dwin.doc_id, dwin.d, iwin.item_id, iwin.v, p - q AS delta, list(DISTINCT q) AS qs
  FROM dwin JOIN iwin ON dwin.w = iwin.w GROUP BY ALL),
hit AS (SELECT *, len(qs) AS n_windows FROM hit0),
near AS (SELECT hit.*, item_windows FROM hit JOIN isz ON hit.item_id = isz.item_id AND hit.v = isz.v WHERE n_windows >= {COVER} * item_windows),
pl AS (SELECT near.*, it.t FROM near JOIN it ON near.item_id = it.item_id AND near.v = it.v),
sl AS (SELECT doc_id, item_id, n_windows, item_windows,
  list_filter(list_transform(generate_series(1, len(v)), lambda i: CASE WHEN t[i] IN ('#', '@', '%') AND i + delta >= 1 AND i + delta <= len(d) AND len(list_filter(qs, lambda q: q <= i AND i < q + {WINDOW})) > 0 THEN {{'mine': v[i], 'theirs': d[i + delta]}} END), lambda s: s IS NOT NULL) AS slots FROM pl),
ok AS (SELECT * FROM sl WHERE len(list_distinct(slots)) = len(list_distinct(list_transform(slots, lambda s: s.mine))))
SELECT doc_id, item_id, CAST(max(n_windows) AS BIGINT) AS n_windows, CAST(max(item_windows) AS BIGINT) AS item_windows,
  CAST(max(len(slots)) AS BIGINT) AS n_slots, min(len(list_filter(slots, lambda s: s.mine <> s.theirs)) > 0) AS reparameterised
FROM ok GROUP BY doc_id, item_id
"""
