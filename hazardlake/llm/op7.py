"""Query op7: the quality ledger of every document and the verdict of the current policy."""
from __future__ import annotations

from pyspark.sql import functions as F

from hazardlake.llm import rules
from hazardlake.llm.common import table

POLICY = "2024.1"


def op7_quality_rules(spark, sf_dir):
    rows = rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       rules.rejected("base").alias("base_failed"), (~rules.rejected(POLICY)).alias("kept"), "failures")


ORACLE = r"""
with t as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
m as (select rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from t),
w as (select rid, unnest(ws) as word, unnest(generate_series(1, len(ws))) as p from m where len(ws) > 0),
g as (select rid, p, array_to_string([word, lead(word, 1) over s, lead(word, 2) over s, lead(word, 3) over s, lead(word, 4) over s,
        lead(word, 5) over s, lead(word, 6) over s, lead(word, 7) over s], ' ') as gram, lead(word, 7) over s as last
      from w window s as (partition by rid order by p)),
r as (select rid, p from (select rid, p, count(*) over (partition by rid, gram) as n from g where last is not null) where n > 1),
c as (select rid, sum(least(8, coalesce(nxt - p, 8))) as n from
        (select rid, p, lead(p) over (partition by rid order by p) as nxt from r) group by rid),
x as (select doc_id, cast(len(ws) as bigint) as n_words,
        cast(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
        cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
        cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
        cast(coalesce(c.n, 0) as bigint) as n_repeat_words, len(ls) as n_lines,
        length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) as n_upper,
        length(text) - length(replace(text, '!', '')) as n_exclaim
      from m left join c using (rid)),
f as (select *, case when n_words < 20 then 1 else 0 end + case when 100 * n_repeat_words > 30 * n_words then 2 else 0 end
        + case when 100 * n_symbols > 10 * n_words then 4 else 0 end + case when 100 * n_dup_lines > 50 * n_lines then 8 else 0 end
        + case when 100 * n_upper > 30 * word_chars then 16 else 0 end + case when 100 * n_exclaim > 30 * n_words then 32 else 0 end
        + case when word_chars > 30 * n_words then 64 else 0 end as failures from x)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) <> 0 as base_failed,
       failures = 0 as kept, cast(failures as bigint) as failures from f
"""
