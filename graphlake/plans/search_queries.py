"""Searches with words that stand for others, and words dropped until something is found; names with placeholders. Each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import assembly, search
from .queries import query


def _search_sql(sentence: str, tok: str) -> str:
    """The search over ``tok`` (id, token, level): every token compared with every word, every set of words tried."""
    words, _ = search.query_words(sentence)
    meanings = []
    for i, w in enumerate(words):
        meanings.append(f"select token, {i} as word, case when token = '{w}' then 4 else 1 end as weight from v where starts_with(token, '{w}') or starts_with(token, '{search._stem(w)}')")
        meanings.append(
            f"select * from (select token, {i}, 2 from v where not regexp_matches(token, '[0-9]') and length(token) >= {text.ABBREVIATION_MIN} and length(token) < {len(w)} and token[1] = '{w[0]}'"
            f" and regexp_matches('{w}', '^' || array_to_string(string_split(token, ''), '.*')) order by length(token) desc, token limit {text.ABBREVIATIONS_PER_WORD})"
        )
        if search._typos(w):
            meanings.append(f"select token, {i}, 1 from v where damerau_levenshtein(token, '{w}') <= {search._typos(w)}")
    n = len(words)
    name = lambda kept, keep: " ".join(w for i, w in enumerate(words) if (kept >> i & 1) == keep)
    tried = ", ".join(f"({at}, {kept}, '{name(kept, 1)}', '{name(kept, 0)}')" for at, kept in enumerate(search.lattice(n)))
    score = " + ".join(f"case when kept & {1 << i} > 0 then coalesce(w{i}, 0) else 0 end" for i in range(n))
    return f"""tok as ({tok}), v as (select distinct token from tok), m as (select token, word, max(weight) as weight from ({" union all ".join(meanings)}) group by token, word),
  best as (select id, level, {", ".join(f"max(weight) filter (word = {i}) as w{i}" for i in range(n))} from tok join m using (token) group by id, level),
  bits as (select *, {" + ".join(f"case when w{i} is not null then {1 << i} else 0 end" for i in range(n))} as bits from best),
  tried as (select * from (values {tried}) x(rank, kept, kept_words, dropped_words)),
  thing as (select t.* from tried t where exists (select 1 from bits b where not b.level and b.bits & t.kept = t.kept) order by rank limit 1),
  above as (select t.* from tried t where exists (select 1 from bits b where b.level and b.bits & t.kept = t.kept) order by rank limit 1),
  told as (select * from thing union all select * from above where not exists (select 1 from thing))
  select b.id, cast((select {score} from told) as integer) as score, b.level, (select kept_words from told) as kept, (select dropped_words from told) as dropped from bits b
  where (not b.level and b.bits & (select kept from thing) = (select kept from thing)) or (b.level and b.bits & (select kept from thing) = (select kept from thing))
    or (b.level and b.bits & (select kept from above) = (select kept from above) and (select rank from above) <= coalesce((select rank from thing), 99))"""


_SPLIT = r"[^\p{L}\p{N}_]+"
_PARTS_SENTENCE = "How can I find the smlal widgte, an anvil of the economi?"
_PARTS_SQL = f"""select distinct 'part:' || p_partkey as id, unnest(string_split_regex(lower(p_name || ' ' || p_type), '{_SPLIT}')) as token, false as level from part
  union select distinct 'brand:' || p_brand, unnest(string_split_regex(lower(p_name || ' ' || p_type), '{_SPLIT}')), true from part"""


@query("search_dropped", f"with {_search_sql(_PARTS_SENTENCE, _PARTS_SQL)}")
def search_dropped(t):
    """Parts and their brands: typos, a prefix; brands have all words and do not end the search."""
    said = F.concat_ws(" ", "p_name", "p_type")
    things = search.index(t.part.select(F.concat(F.lit("part:"), "p_partkey").alias("id"), said.alias("said")), "id", "said")
    levels = search.index(t.part.select(F.concat(F.lit("brand:"), "p_brand").alias("id"), said.alias("said")), "id", "said").distinct()
    words, _ = search.query_words(_PARTS_SENTENCE)
    return search.search(things.unionByName(levels), words, levels=levels.select("id"))


_DOCUMENTS_SENTENCE = "where is the thtoin with a thble, quixotical or wtih er"


@query("search_documents", f"with {_search_sql(_DOCUMENTS_SENTENCE, f'''select distinct doc_id as id, token, false as level from (select doc_id, unnest(string_split_regex(lower(text), '{_SPLIT}')) as token from documents) where token <> {chr(39) * 2}''')}")
def search_documents(t):
    """Whole texts of all documents, whose words are the vocabulary."""
    words, _ = search.query_words(_DOCUMENTS_SENTENCE)
    return search.search(search.index(t.documents, "doc_id", "text"), words)


@query("typo_candidates", f"""with v as (select distinct unnest(string_split_regex(lower(text), '{_SPLIT}')) as token from documents), w as (select * from (values ('cleint', 1), ('thingss', 1), ('benchmrak', 2), ('conversaiton', 2)) x(word, most))
  select word, token from w join v on damerau_levenshtein(token, word) <= most""")
def typo_candidates(t):
    """Words of the texts within a typo of some, or two of long ones, by deletion neighbourhoods."""
    vocabulary = search.distinct_tokens(search.index(t.documents, "doc_id", "text"))
    words = ["cleint", "thingss", "benchmrak", "conversaiton"]
    near = search.matches(vocabulary, words, most=0)
    word = F.element_at(F.array(*map(F.lit, words)), F.col("word") + 1)
    close = F.lit(False)
    for i, w in enumerate(words):
        close = close | ((F.col("word") == i) & search._within(F.col("token"), w, search._typos(w)))
    return near.where(close).select(word.alias("word"), "token")


@query("name_templates", """with names as (select 'shop-' || lpad(cast(s_suppkey as varchar), 5, '0') || '-' || case when s_nationkey % 2 = 0 then 'api' else 'web' end as name, s_suppkey as id from supplier),
  asked as (select distinct o_custkey % 3 as kind, lpad(cast(o_custkey % 500 as varchar), 5, '0') as no from orders),
  t as (select case kind when 0 then '${env}-' || no || '-${kind}' when 1 then 'shop-' || no[1:4] || '${last}-api' else 'shop-${x}' || no[5:5] || '-web' end as template, case kind when 0 then '^.+-' || no || '-.+$' when 1 then '^shop-' || no[1:4] || '.+-api$' else '^shop-.+' || no[5:5] || '-web$' end as regex from asked)
  select template, count(distinct id) as fits, min(id) as id from (select distinct template, regex from t) join names on regexp_matches(name, regex) group by template""")
def name_templates(t):
    """Templates with placeholders and how many applications' names fit each."""
    no = F.lpad((F.col("o_custkey") % 500).cast("string"), 5, "0")
    kind = F.col("o_custkey") % 3
    template = F.when(kind == 0, F.concat(F.lit("${env}-"), no, F.lit("-${kind}"))).when(kind == 1, F.concat(F.lit("shop-"), F.left(no, F.lit(4)), F.lit("${last}-api"))).otherwise(F.concat(F.lit("shop-${x}"), F.right(no, F.lit(1)), F.lit("-web")))
    name = F.concat(F.lit("shop-"), F.lpad(F.col("s_suppkey").cast("string"), 5, "0"), F.when(F.col("s_nationkey") % 2 == 0, "-api").otherwise("-web"))
    return assembly.template_fits(t.orders.select(template.alias("template")), t.supplier.select(name.alias("name"), F.col("s_suppkey").alias("id"))).groupBy("template").agg(F.count_distinct("id").alias("fits"), F.min("id").alias("id"))
