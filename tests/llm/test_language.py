import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from factloom.llm import language

SF = "/root/testdata/sf0.01"


def test_text_and_host_alone_tell_the_language(spark):
    """Documents outside the sample, with nothing declared."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs.where("doc_id % 2 = 0"))
    held = docs.where("doc_id % 2 = 1")
    rows = held.selectExpr("doc_id as id", "text", "cast(null as string) as declared", "source as host")
    got = language.identify(rows, model).toPandas().merge(held.select("doc_id", "lang").toPandas(), left_on="id", right_on="doc_id", suffixes=("", "_true"))
    assert (got.lang == got.lang_true).mean() > 0.99 and got.keep.mean() > 0.99


def test_pages_use_markup_and_address(spark):
    got = language.pages(spark.read.parquet(f"{SF}/pages.parquet"), spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    assert len(got) == 250 and (got.lang == got.declared).mean() > 0.98


def test_declaration_decides_what_the_text_leaves_open(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clear = docs.where("n_chars > 300 and doc_id % 3 = 0").selectExpr("doc_id as id", "text", "lang as declared", "concat(lang, '.example.', lang) as host")
    odd = spark.createDataFrame([(-1, "a", "fr", "fr.example.fr"), (-2, "a", "de", "new.example.de"), (-3, "", "de", None), (-4, None, None, None), (-5, " \t\n", "", ""), (-6, "中文字符" * 50, None, None)], clear.schema)
    got = {r.id: r for r in language.identify(clear.unionByName(odd).unionByName(odd.where("id = -1")), language.train(docs)).collect()}
    assert got[-1].lang == "fr" and got[-1].keep and got[-2].lang == "de"
    assert not any(got[i].keep for i in (-3, -4, -5, -6)) and got[-6].lang == language.UNKNOWN
    for r in got.values():
        assert 0 <= r.posterior <= 1


def test_rows_nulls_and_empty_tables(docs, empty):
    got = language.documents(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert {r.doc_id for r in got if not r.keep} >= {200, 201, 202}
    assert language.documents(empty).count() == 0


def test_a_language_outside_the_smallest_hashes_has_a_model(spark):
    """Three documents among 3,000, trained on 100."""
    docs = spark.range(3000).selectExpr("id as doc_id", "case when id in (7, 1234, 2500) then 'xx' when id % 2 = 0 then 'en' else 'de' end as lang")
    docs = docs.selectExpr("*", "repeat(case lang when 'xx' then 'qzu wkx jqv ' when 'en' then 'the other thing ' else 'eine schoene sache ' end, 20) as text", "concat(lang, '.example') as source")
    langs, _ = language.train(docs, 100)
    assert langs == ["de", "en", "xx", language.UNKNOWN]
    rows = docs.where("doc_id < 20 or lang = 'xx'").selectExpr("doc_id as id", "text", "cast(null as string) as declared", "source as host")
    got = {r.id: r for r in language.identify(rows, language.train(docs, 100)).collect()}
    assert all(got[i].lang == "xx" and got[i].keep for i in (7, 1234, 2500)) and got[0].lang == "en"


def plain_fusion(rows, langs, table):
    """The fusion for each row by itself, from sums over all rows: (lang, posterior, text_lang, keep)."""
    k, low = len(langs), lambda x: (x or "").lower()
    soft, lls = [], []
    for _, text, _, _ in rows:
        b = bytes(x + 32 if 65 <= x <= 90 else 32 if x < 33 else x for x in (text or "").encode())
        total = [0.0] * k
        for i in range(len(b) - 2):
            code = (b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761 % 2**32 >> 32 - language.BITS
            total = [t + float(table[code][j]) for j, t in enumerate(total)]
        ll = [max(language.TEMPER * (t - max(total)), -language.LIMIT) for t in total]
        lls.append(ll)
        soft.append([math.exp(x) / sum(map(math.exp, ll)) for x in ll])
    said = [i for i, r in enumerate(rows) if (r[1] or "").strip()]
    column = lambda ids: [math.fsum(soft[i][j] for i in ids) for j in range(k)]
    suffix = lambda h: (re.findall(r"\.([a-z0-9-]+)$", h) or [""])[0]
    parent = lambda h: (re.findall(r"[^.]+\.[^.]+$", h) or [""])[0]
    host = [low(r[3]) for r in rows]
    every = column(said)
    even = [(n + 1) / (sum(every) + k) for n in every[:-1]]
    overall = [p / sum(even) * (1 - language.UNKNOWN_PRIOR) for p in even] + [language.UNKNOWN_PRIOR]
    blend = lambda n, prior, m: [(x + m * p) / (sum(n) + m) for x, p in zip(n, prior, strict=True)]

    def given(value_of, value):
        values = {value_of(i) for i in said} - {""}
        if value not in values:
            return [0.0] * k
        own, total = column([i for i in said if value_of(i) == value]), column([i for i in said if value_of(i)])
        return [math.log((n + language.SMOOTH_VALUE) / (t + language.SMOOTH_VALUE * (len(values) + 1))) for n, t in zip(own, total, strict=True)]

    for i, r in enumerate(rows):
        prior = overall
        if host[i] in {host[j] for j in said}:
            above = overall
            if parent(host[i]):
                above = blend(column([j for j in said if parent(host[j]) == parent(host[i])]), overall, language.SMOOTH_PARENT)
            prior = blend(column([j for j in said if host[j] == host[i]]), above, language.SMOOTH_HOST)
        d, s = given(lambda j: low(rows[j][2]), low(r[2])), given(lambda j: suffix(host[j]), suffix(host[i]))
        v = [a + math.log(b) + x + y for a, b, x, y in zip(lls[i], prior, d, s, strict=True)]
        best = v.index(max(v))
        posterior = 1 / math.fsum(math.exp(x - max(v)) for x in v)
        text = langs[lls[i].index(max(lls[i]))] if i in said else None
        yield r[0], langs[best], posterior, text, i in said and langs[best] != language.UNKNOWN and posterior >= language.ACCEPT


def test_fusion_is_the_plain_one(spark):
    rng = random.Random(3)
    langs = ["aa", "bb", "cc", language.UNKNOWN]
    table = np.random.default_rng(5).normal(-11, 1.5, (1 << language.BITS, 4)).astype(np.float32)
    hosts = [None, "", "x.example.aa", "y.example.aa", "z.EXAMPLE.aa", "a.b.other.bb", "other.bb", "lone", "odd.c_c"]
    texts = [None, "", " \t", "ab", "The tree", "Éa ÖÖ über", "long text " * 20, "abc", "xyz xyz"]
    rows = [(i, rng.choice(texts) if i % 3 else "w" + str(i) * rng.randint(1, 5), rng.choice([None, "", "aa", "BB", "xx"]), rng.choice(hosts)) for i in range(120)]
    rows += [rows[5], rows[6]]
    df = spark.createDataFrame(rows, "id long, text string, declared string, host string").repartition(4)
    got = sorted((r.id, r.lang, r.posterior, r.text_lang, r.keep) for r in language.identify(df, (langs, table)).select("id", "lang", "posterior", F.coalesce("text_lang", F.lit("-")).alias("text_lang"), "keep").collect())
    want = sorted((a, b, c, d or "-", e) for a, b, c, d, e in plain_fusion(rows, langs, table))
    assert len({w[1] for w in want}) > 2
    for g, w in zip(got, want, strict=True):
        assert (g[0], g[1], g[3], g[4]) == (w[0], w[1], w[3], w[4]) and abs(g[2] - w[2]) < 1e-6
