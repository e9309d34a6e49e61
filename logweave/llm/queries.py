"""One query per operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from logweave.llm import fingerprints, html, jaccard, language, neighbours, packing, phrases, pii, secrets, sentencepiece, substrings, vector_dedup, whitening
from logweave.llm.common import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


@query("op1_secret_scan")
def op1_secret_scan(spark, sf_dir):
    return secrets.secret_digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


@query("op3_language_id")
def op3_language_id(spark, sf_dir):
    found = language.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", (language.fold() == 2).alias("held_out"), "lang_pred", F.col("score"))


@query("op7_personal_data")
def op7_personal_data(spark, sf_dir):
    return pii.personal_digest(pii.find_personal(table(spark, sf_dir, "documents")))


@query("op8_fingerprints")
def op8_fingerprints(spark, sf_dir):
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


@query("op4_main_text")
def op4_main_text(spark, sf_dir):
    return html.extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query(
    "op9_repeated_passages",
    r"""with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
    w as (select doc_id, unnest(range(1, len(ws) - 18)) as s, ws from d where len(ws) >= 20),
    k as (select doc_id, s, array_to_string(ws[s:s + 19], ' ') as key from w),
    f as (select doc_id, s, row_number() over (partition by key order by doc_id, s) as nth from k),
    gone as (select doc_id, list(distinct p) as ps
      from (select doc_id, unnest(range(s, s + 20)) as p from f where nth > 1) group by doc_id),
    kept as (select d.doc_id, len(ws) as n_words, coalesce(len(ps), 0) as n_removed,
      case when ps is null then ws else list_transform(
        list_sort(list_filter(range(1, len(ws) + 1), lambda i: not list_contains(ps, i))), lambda i: ws[i]) end as own
      from d left join gone using (doc_id))
    select doc_id, n_words, n_removed, sha256(array_to_string(own, ' ')) as kept_sha256 from kept""",
)
def op9_repeated_passages(spark, sf_dir):
    return substrings.repeat_digest(substrings.find_repeats(table(spark, sf_dir, "documents")))


@query(
    "op2_jaccard_join",
    r"""with recursive d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
    g as (select doc_id, list_distinct(case when len(ws) >= 5
        then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
        else [array_to_string(ws, ' ')] end) as gs from d where len(ws) > 0),
    s as (select doc_id, unnest(gs) as w, len(gs) as n from g),
    p as (select a.doc_id as u, b.doc_id as v from s a join s b on a.w = b.w and a.doc_id <> b.doc_id
      group by a.doc_id, b.doc_id, a.n, b.n having count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
    reach(u, v) as (select u, v from p union select reach.u, p.v from reach join p on reach.v = p.u),
    c as (select u, min(v) as least from reach group by u),
    l as (select u, count(*) as links from p group by u)
    select d.doc_id, least(d.doc_id, coalesce(c.least, d.doc_id)) as class_id, coalesce(links, 0) as n_links
    from d left join c on c.u = d.doc_id left join l on l.u = d.doc_id""",
)
def op2_jaccard_join(spark, sf_dir):
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


@query("op6_retrieval_packing")
def op6_retrieval_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


@query("op10_nearest_neighbours")
def op10_nearest_neighbours(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, rows.where("vec_id % 100 = 0"))


@query("op5_sentencepiece")
def op5_sentencepiece(spark, sf_dir):
    return sentencepiece.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query(
    "op11_embedding_dedup",
    """with recursive e as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
    ok as (select * from e where vec_id is not null and label is not null and len(v) > 0
      and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
    p as (select a.vec_id as u, b.vec_id as w from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
      where list_cosine_similarity(a.v, b.v) >= 0.93),
    reach(u, w) as (select u, w from p union select reach.u, p.w from reach join p on reach.w = p.u),
    c as (select u, min(w) as least from reach group by u),
    l as (select u, count(*) as links from p group by u)
    select vec_id, coalesce(links, 0) as n_links, least(vec_id, coalesce(c.least, vec_id)) as component_id,
      vec_id = least(vec_id, coalesce(c.least, vec_id)) as kept
    from e left join c on c.u = e.vec_id left join l on l.u = e.vec_id""",
)
def op11_embedding_dedup(spark, sf_dir):
    return vector_dedup.vector_groups(table(spark, sf_dir, "embeddings"))


@query(
    "op12_collocations",
    r"""with d as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
    p as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from d),
    total as (select lang, sum(len(ws)) as n from p group by lang),
    g as (select lang, unnest(flatten(list_transform(range(1, 6), lambda k: list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])))) as p from p),
    f as (select lang, p, count(*) as f from g group by lang, p having count(*) >= 100),
    c as (select lang, p, f as a, ' ' || array_to_string(p, ' ') || ' ' as shown from f where len(p) >= 2),
    kept as (select * from c where not exists (select 1 from c q where q.lang = c.lang and len(q.p) > len(c.p)
      and 100 * q.a >= 100 * c.a and contains(q.shown, c.shown))),
    cuts as (select lang, p, a, unnest(range(1, len(p))) as k from kept),
    scored as (select c.lang, c.p, c.a, c.k, x.f as l, y.f as r, n, (cast(1000 as hugeint) * c.a * n) // (cast(x.f as hugeint) * y.f) as score
      from cuts c join f x on x.lang = c.lang and x.p = c.p[1:c.k] join f y on y.lang = c.lang and y.p = c.p[c.k + 1:len(c.p)] join total t on t.lang = c.lang),
    best as (select *, row_number() over (partition by lang, p order by score, k) as nth from scored),
    ranked as (select *, array_to_string(p, ' ') as phrase, row_number() over (partition by lang order by score desc, a desc, array_to_string(p, ' ')) as rank
      from best where nth = 1)
    select lang, rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from ranked where rank <= 2000""",
)
def op12_collocations(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query("op13_whitening")
def op13_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
