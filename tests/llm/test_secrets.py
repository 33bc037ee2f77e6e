"""Secret scan against brute force, and the randomness tests."""

import base64
import random
import re

from pyspark.sql import functions as F

from netwarden.llm import secrets


def brute(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


PIECES = ["the", "é😀", 'PASSWORD = "', "token:", "AKIA", "AKIA" + "A1" * 7, "abcdef0123456789" * 2, "apikey=", "api_key : ", "secret'= '", "xyzzy123", "short", "\n", "=", "token==abcdefgh", "f"]


def random_token(rng, n):
    return base64.b64encode(rng.randbytes(n)).decode()


def texts():
    rng = random.Random(5)
    out = [None, "", "f" * 100_000, "AKIA" * 5000, "token=" * 3000 + "abcdefgh1"]
    for i in range(250):
        text = (" " if i % 2 else "").join(rng.choices(PIECES, k=rng.randint(0, 30)))
        out.append(text + (" see " + random_token(rng, 30) if i % 3 == 0 else " internationalizationandlocalization_of-things/in/some/path" if i % 5 == 0 else ""))
    return out


def test_base_spans_and_random_tokens(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, spans string").repartition(3)
    got = {r["id"]: [tuple(x) for x in r["spans"]] for r in secrets.scan(docs).collect()}
    for i, t in rows:
        assert [x for x in got[i] if x[1] < 3] == brute(t)
    found = [t[s:e] for i, t in rows for s, k, e in got[i] if k == 3]
    assert len(found) > 60 and not any("path" in x or "internat" in x for x in found)


def test_ordinary_tokens_alone_are_not_found(spark):
    words = ["some-ordinary-words-joined-by-hyphens", "AnotherLongCamelCaseIdentifierName", "averyveryverylongwordwithoutmeaning", "12345678901234567890123", "path/to/some/directory/with/file_name"]
    docs = spark.createDataFrame([(i, " ".join(words)) for i in range(50)], "doc_id long, text string")
    assert secrets.scan(docs).filter(F.size("spans") > 0).count() == 0


def test_random_tokens_after_an_equals_sign(spark):
    rng = random.Random(9)
    forms = ["AUTH={}", "export CREDENTIAL={}", "x := {}", "y :={}", "https://h.example/p?sig={}&n=1", "?a=b&key={}", "AVERYLONGNAMEOFAVARIABLE={}", "k=={}", "a='{}'"]
    rows = []
    for i in range(90):
        token = random_token(rng, 33)
        rows.append((i, "é " + forms[i % len(forms)].format(token) + " end", token))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r["id"]: [tuple(x) for x in r["spans"]] for r in secrets.scan(docs).collect()}
    held = [(t.index(token), 3, t.index(token) + len(token)) in got[i] for i, t, token in rows]
    for k, form in enumerate(forms):
        assert sum(held[k :: len(forms)]) >= 9, form
    assert not any("AVERYLONGNAME" in t[s:e] for i, t, _ in rows for s, _, e in got[i])


def test_masking(spark):
    rows = [(1, "é😀 token = abcdefgh1 end", 24), (1, "é😀 token = abcdefgh1 end", 24), (None, None, None), (2, "", 0), (3, "token=" + "a1" * 20 + "!", 47), (4, "clean", 5)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_chars long, found string")
    left = secrets.without_secrets(docs)
    assert left.columns == docs.columns
    assert sorted(((r["doc_id"] or 0), r["text"], r["n_chars"]) for r in left.collect() if r["text"] is not None) == [
        (1, "é😀 [SECRET] end", 15), (1, "é😀 [SECRET] end", 15), (2, "", 0), (3, "[SECRET]!", 9), (4, "clean", 5)]
    assert left.count() == 6 and secrets.without_secrets(docs.limit(0)).count() == 0 and secrets.scan(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "token=abcdefgh1")], "doc_id long, text string")
    plan = secrets.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
