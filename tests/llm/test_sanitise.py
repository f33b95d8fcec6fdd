"""Personal data against Python's regular expressions and a brute-force count of disclosure."""

import hashlib
import math
import re
from collections import Counter

import pytest
import regex
from pyspark.sql import Row

from clausewise.llm import sanitise

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def spans(text):
    out = []
    for i, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x.lstrip("0")[:9] or 0) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), i, m.end(), kind))
    return sorted(out)


ODD = ["", None, "a@b", "é a@b.c_d@e.f. x@y.z", "a@b.c@d.e", ".a@-.-", "1.2.3.4.5.6.7.8", "01.002.000255.0", "256.1.1.1 1.1.1.256 1.2.3", "4111 1111-1111 1111", "4111  1111 1111 1111", "41111111111111111111111", "+1 (555) 010-9999) ", "+12", "+1-2 +123456789", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "👩 a@b.co 👩 +44 20 7946 0958 4111111111111111 10.0.0.1", "0" * 12, "1 2 " * 3000, "a" * 20000 + "@" + "b." * 500, "1" * 20000 + ".1.1.1", " ".join(f"u{i}@h{i}.org" for i in range(700))]


def test_base(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(r.doc_id + 100, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    d = spark.createDataFrame([Row(doc_id=i, text=t, base="x", key=1) for i, t in rows], "doc_id long, text string, base string, key int")
    got = {r.doc_id: r for r in sanitise.digest(d).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = spans(t or "")
        said = [f"{k}:{a}:{b}" for a, _, b, k in want]
        assert got[i].base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest(), (i, t and t[:80])
        assert [got[i][f"n_{k}"] for k in PLAIN] == [sum(w[3] == k for w in want) for k in PLAIN]
        mine = got[i].spans.split(",") if got[i].spans else []
        assert [x for x in mine if not x.startswith("term")] == said
        if not said:
            assert not mine


def entities(text):
    out = set()
    for a, i, b, _ in spans(text):
        v = text[a:b]
        d = re.sub("[^0-9]", "", v)
        block = [v.split("@")[-1].lower(), ".".join(v.split(".")[:2]), d[:6], d[:4]][i]
        out |= {f"{i}:{v}", f"{i}/{block}", f"{i}"}
    return out


def terms(text):
    for a, _, b, _ in spans(text):
        text = text[:a] + "0" * (b - a) + text[b:]
    return [(m.start(), m.end(), m[0].lower()) for m in regex.finditer(r"\p{L}{3,}", text)]


def brute(texts):
    """Told terms {(entity, term): (share, keep)} by counting over the distinct texts."""
    texts = {t for t in texts if t is not None}
    n = len(texts)
    n_t, n_e, n_te = Counter(), Counter(), Counter()
    for t in texts:
        w, e = {x for *_, x in terms(t)}, entities(t)
        n_t.update(w)
        n_e.update(e)
        n_te.update((x, y) for x in e for y in w)
    share = lambda te, t, e: math.log2(te * n / (t * e)) / math.log2(n / e) if e < n else 0.0
    out = {}
    for (e, w), m in n_te.items():
        if m >= sanitise.SUPPORT and (x := share(m, n_t[w], n_e[e])) >= sanitise.GENERALISE:
            keep = 0
            for size in (3 << i for i in range(12)):
                if x < sanitise.REMOVE and size < len(w):
                    like = [v for v in n_t if v.startswith(w[:size])]
                    if share(sum(n_te[e, v] for v in like), sum(n_t[v] for v in like), n_e[e]) < sanitise.GENERALISE:
                        keep = size
            out[e, w] = (x, keep)
    return out


def told_in(text, told):
    """(start, end, keep) of the disclosing terms of a text."""
    own = entities(text)
    found = []
    for a, b, w in terms(text):
        keeps = [told[e, w][1] for e in own if (e, w) in told]
        found += [(a, b, min(keeps))] if keeps else []
    return found


def edited(text, told):
    edits = sorted([(a, b, sanitise.REPLACED[k]) for a, _, b, k in spans(text)] + [(a, b, text[a : a + k] + "*" if k else "") for a, b, k in told_in(text, told)])
    out, at = "", 0
    for a, b, by in edits:
        if a >= at:
            out += text[at:a] + by
        at = max(at, b)
    return out + text[at:]


@pytest.mark.parametrize("rows", [1 << 20, 0])
def test_disclosure_of_documents(spark, monkeypatch, rows):
    """Spans, generalised and removed terms of the given tables, as counted by brute force; also without any broadcast."""
    monkeypatch.setattr(sanitise, "BROADCAST_ROWS", rows)
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in d.collect()}
    told = brute(texts.values())
    got = {r.doc_id: r for r in sanitise.digest(d).collect()}
    n = kept = 0
    for i, t in texts.items():
        want = told_in(t or "", told)
        assert [x for x in got[i].spans.split(",") if x.startswith("term")] == [f"term:{a}:{b}" for a, b, _ in want], i
        assert (got[i].n_term, got[i].n_generalised) == (len(want), sum(k > 0 for *_, k in want))
        n, kept = n + len(want), kept + sum(k > 0 for *_, k in want)
    assert n > 5 and kept > 0 and len(told) > 0
    out = {r.doc_id: r.text for r in sanitise.sanitised(d).collect()}
    assert all(out[i] == (None if t is None else edited(t, told)) for i, t in texts.items())
    assert all(out[i] == t for i, t in texts.items() if t is None or not spans(t))


def test_disclosure(spark):
    """Terms that are only found with an entity go, terms that tell less are cut, common ones stay; columns of any name stay."""
    filler = ["alpha beta gamma", "delta beta", "gamma alpha delta"]
    texts = [f"{filler[i % 3]} text{chr(97 + i % 26)}{chr(97 + i // 26)} nothing" for i in range(60)]
    texts += [f"{filler[i % 3]} manager Grimalkin Thornburg wrote to boss@acme.org about beta {x}" for i, x in enumerate(("one", "two", "three", "four", "five"))]
    texts += [texts[-1]] * 3 + ["far away Grimalkin sleeps", "Thornburg", "alpha Thornbury hills", "beta Thornbush"] + [f"gamma Thorn{x}" for x in ("ham", "ton", "dike", "ley")]
    d = spark.createDataFrame([Row(doc_id=i, text=t, base="b", key=i, row="r", terms=None, n_t=1) for i, t in enumerate(texts)], "doc_id long, text string, base string, key int, row string, terms string, n_t int")
    rows = sanitise.with_base(d.select("text")).withColumn("key", sanitise.F.md5("text"))
    got = {(r.entity, r.term): (r.share, r.keep) for r in sanitise.disclosing(sanitise.candidates(rows), d).collect()}
    told = brute(texts)
    assert {k: v[0] for k, v in got.items()} == pytest.approx({k: v[0] for k, v in told.items()}) and {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in told.items()}
    assert all((e, w) in got for e in ("0:boss@acme.org", "0/acme.org", "0") for w in ("grimalkin", "manager"))
    assert {k[1] for k, v in got.items() if v[1]} >= {"thornburg"}
    out = {r.doc_id: r for r in sanitise.sanitised(d).collect()}
    assert all(out[i].text == edited(t, told) and (out[i].base, out[i].key, out[i].row, out[i].terms, out[i].n_t) == ("b", i, "r", None, 1) for i, t in enumerate(texts))
    assert "[EMAIL]" in out[60].text and "Grimalkin" not in out[60].text and "beta" in out[60].text and "Thornburg" not in out[60].text and "Tho" in out[60].text
    assert out[68].text == texts[68] and all(out[i].text == texts[i] for i in range(60))


def test_sanitised_text(spark):
    d = spark.createDataFrame([(1, "mail a@b.co, ip 10.0.0.1", "en"), (2, None, None), (2, None, None), (None, "+1 555 010 9999, 4111111111111111", "de")], "doc_id long, text string, lang string")
    got = sorted(((r.doc_id, r.text, r.lang) for r in sanitise.sanitised(d).collect()), key=str)
    assert got == sorted([(1, "mail [EMAIL], ip [IP]", "en"), (2, None, None), (2, None, None), (None, "[PHONE], [CARD]", "de")], key=str)
    assert sanitise.digest(d.limit(0)).count() == 0


def test_whole_texts(spark):
    """A disclosing term counts and goes wherever it is in an entity's texts, at any distance; letters of a cut word are no term."""
    pad = "alpha beta gamma delta " * 12
    texts = [f"{pad} plain{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    texts += [f"Grimalkin {pad}{x} boss@acme.org {x} {pad} signed grimalkin" for x in ("one", "two", "three", "four")]
    texts += [f"{pad} Hobbes {pad}{x}" for x in ("one", "two", "three", "four")] + ["Grimalkin without"]
    d = spark.createDataFrame([Row(doc_id=i, text=t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in sanitise.sanitised(d).collect()}
    assert all("grimalkin" not in out[i].lower() and "[EMAIL]" in out[i] and "alpha beta" in out[i] for i in range(60, 64))
    assert all(out[i] == texts[i] for i in range(len(texts)) if not 60 <= i < 64)
    got = {r.doc_id: r.spans for r in sanitise.digest(d).collect()}
    spans = [x for x in got[60].split(",") if x.startswith("term")]
    assert spans == [f"term:{m.start()}:{m.end()}" for m in re.finditer("(?i)grimalkin|signed", texts[60])]
