import random
import re
import string

import pytest

pytest.importorskip("larkspur.llm")

from larkspur.llm import secrets  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def votes(spark):
    return secrets.train(spark)


def test_held_out_accuracy(spark, votes):
    """Findings made from another seed, judged in texts of their own."""
    rows = secrets.labelled_findings(1000, seed=99)
    docs = spark.createDataFrame([(i, f"{b}{c}{a}", y) for i, (b, c, a, y) in enumerate(rows)], "doc_id bigint, text string, y double")
    found = {}
    for r in secrets.scan(docs, votes).collect():
        found[r.doc_id] = found.get(r.doc_id, False) or r.secret
    right = sum(found.get(i, False) == bool(y) for i, (_, _, _, y) in enumerate(rows))
    assert right >= 960


def test_query_finds_planted_tokens_only(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = secrets.op5_secret_forest(spark, SF).collect()
    pattern = re.compile(r"(?<![A-Za-z0-9+/_.\-])(?=[A-Za-z+/_.\-]*[0-9])[A-Za-z0-9+/_.\-]{16,}={0,2}")
    want = {(i, k): m.group() for i, t in docs.items() for k, m in enumerate(pattern.finditer(t or ""))}
    assert {(r.doc_id, r.nr) for r in got} == set(want)
    for r in got:
        assert r.length == len(want[r.doc_id, r.nr])
        assert r.secret == bool(re.fullmatch("[0-9a-fA-F]{40}", want[r.doc_id, r.nr])), want[r.doc_id, r.nr]


def test_redaction(spark, votes):
    token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [
        (1, f'a token = "{token}" b token = "{token}"', 5, "x"),
        (2, None, None, "x"),
        (3, "", 0, "x"),
        (4, token, 40, "x"),
        (5, f'{"word " * 30000}token = "{token}"' + " word" * 30000, 1, None),
        (6, "see 9807915762804490 and /var/log/app/file1.html", 48, "y"),
    ]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id bigint, text string, n_chars bigint, c string")
    out = secrets.redact(docs, votes)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == 'a token = "[SECRET]" b token = "[SECRET]"' and got[1].n_chars == len(got[1].text)
    assert (got[2].text, got[3].text, got[6].text, got[6].n_chars) == (None, "", rows[5][1], 48)
    assert token not in got[5].text and got[5].text.startswith("word word") and got[5].text.endswith(" word")
    assert out.count() == 7 and secrets.scan(docs.limit(0), votes).count() == 0


def test_tokens_without_a_key_word(spark, votes):
    """Tokens of each kind are found by their own shape; digests, ids and paths beside a key word are not."""
    rng = random.Random(5)
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    alnum = string.ascii_letters + string.digits
    kinds = {
        "aws": lambda: "AKIA" + pick(string.ascii_uppercase, 15) + pick(string.digits, 1),
        "github": lambda: "ghp_1" + pick(alnum, 35),
        "hex": lambda: pick("0123456789abcdef", 39) + "1",
        "base64": lambda: pick(alnum + "+/", 39) + "1",
    }
    places = ('token = "', "we met on the bridge and left ", "aws access id: ", 'DATABASE_URL = "', "| ", "\n- ", "")
    rows = [(k, p, f"{places[p]}{kinds[k]()}") for k in kinds for p in range(len(places)) for _ in range(60)]
    rows += [("harmless", p, t) for p, t in enumerate((
        "the secret uuid 3f2b8c1d-9a4e-4c77-8b1f-0d9e5a6c7b21", "token commit 04dbebab91ab85687d33eeaaf9ac699e1188f962", "the api is in /usr/share/doc/report2.html",
        "the private key file /home/user/static/images/index1.html", "password card 9807915762804490",
    ))]
    docs = spark.createDataFrame([(i, t, k, p) for i, (k, p, t) in enumerate(rows)], "doc_id bigint, text string, kind string, place int")
    found = {r.doc_id for r in secrets.scan(docs, votes).collect() if r.secret}
    for k in kinds:
        for p in range(len(places)):
            of = [i for i, r in enumerate(rows) if r[:2] == (k, p)]
            assert len(found.intersection(of)) >= 0.95 * len(of), (k, places[p], len(found.intersection(of)))
    assert [r[2] for i, r in enumerate(rows) if r[0] == "harmless" and i in found] == []
    alone = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    out = secrets.redact(spark.createDataFrame([(4, alone, 40, "x")], "doc_id bigint, text string, n_chars bigint, c string"), votes).first()
    assert out.text == secrets.MARK and out.n_chars == len(secrets.MARK)


def test_short_digitless_and_broken_values(spark, votes):
    """Whole values after a key word, passwords of URLs and keys of letters only; ordinary values stay."""
    whole = [
        ('password = "s3cr3tPass!" end', "s3cr3tPass!"), ("the pwd: Tr0ub4dor&3 end", "Tr0ub4dor&3"), ("DB_PASSWORD=kf93jGh2\nx=1", "kf93jGh2"), ("api_key='qwZkPvTnRbXcMsLdHgJf' end", "qwZkPvTnRbXcMsLdHgJf"),
        ("postgres://admin:hX7pqz2w@db.example.org/x", "hX7pqz2w"), ("PIN: 583920 end", "583920"), ("token=ab12cd34ef&user=bob", "ab12cd34ef"), ('{"client_secret": "Zk4!pQ9,x2#Lm", "a": 1}', "Zk4!pQ9,x2#Lm"),
        ('passphrase = "tremble otter candle wix"', "tremble otter candle wix"),
    ]
    plain = ["author: Martinez wrote it", "password: required here", "key: /docs/en/index.html of it", "token = get_token(user)", "mailto:annamaria@example.org", "password=${DB_PASSWORD} end", "a:b@c and auth: x"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([t for t, _ in whole] + plain)], "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in secrets.redact(docs, votes).collect()}
    assert [got[i] for i in range(len(whole))] == [t.replace(c, secrets.MARK) for t, c in whole]
    assert [got[len(whole) + i] for i in range(len(plain))] == plain


def test_the_sql_is_the_model(spark):
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    model, sql = secrets.fitted(spark), secrets.train(spark)
    data = secrets.featured(spark, secrets.labelled_findings(600, seed=5))
    rows = model.transform(data).select(vector_to_array("probability")[1].alias("p"), "prediction", F.expr(sql).alias("score")).collect()
    assert max(abs(r.p - r.score) for r in rows) < 1e-9
    assert all((r.score > 0.5) == (r.prediction == 1.0) for r in rows if abs(r.score - 0.5) > 1e-9)


def plain_scan(spark, model, docs):
    """(doc_id, nr, length, sha256, score, secret) by Python's matching and the model itself."""
    import hashlib

    import regex
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    candidate, rows, keys = regex.compile(secrets.CANDIDATE), [], []
    for k, (_, text) in enumerate(docs):
        found = list(candidate.finditer(text or ""))
        edges = [0, *[x for m in found for x in m.span()], len(text or "")]
        for nr, m in enumerate(found):
            before, after = text[edges[2 * nr] : edges[2 * nr + 1]], text[edges[2 * nr + 2] : edges[2 * nr + 3]]
            rows.append((before[-secrets.CONTEXT :], m.group(), after[: secrets.CONTEXT], float(len(rows))))
            keys.append((k, nr))
    scored = model.transform(secrets.featured(spark, rows)).select("label", vector_to_array("probability")[1].alias("p")).collect() if rows else []
    p = {int(r.label): r.p for r in scored}
    return sorted(str((docs[k][0], nr, len(rows[n][1]), hashlib.sha256(rows[n][1].encode()).hexdigest(), round(round(p[n], 6), 4), p[n] > 0.5)) for n, (k, nr) in enumerate(keys))


def test_query_against_a_plain_scan_and_the_model(spark):
    """The whole query on its table, and odd texts: values of any length, breaks, quotes, repeats, nulls."""
    model = secrets.fitted(spark)
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = secrets.op5_secret_forest(spark, SF).collect()
    assert sorted(str((r.doc_id, r.nr, r.length, r.sha256, round(r.score, 4), r.secret)) for r in got) == plain_scan(spark, model, table)
    rng = random.Random(7)
    parts = ["password = ", "token: \"", "api_key='", "=", ":", ",", ";", ")", "]", "&x=", "{", "(", "|", "?", ">", "<b>", " ", "\n", "Xk9!?", "s3cr3tPass", "https://bob:", "@host", "/usr/share/lib42/", '"', "'", "é", "0123456789abcdef0"]
    odd = [(k, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 40)))) for k in range(600)]
    odd += [(-1, None), (None, "password = " + "Xk9!?" * 70 + "ENDSECRET"), (5, 'secret = "' + "word " * 60 + '"'), (5, 'secret = "' + "word " * 60 + '"'), (6, "pwd=" + "a,b;" * 5000 + "c)]},;"), (7, "")]
    docs = spark.createDataFrame(odd, "doc_id bigint, text string")
    own = secrets.scan(docs, secrets.train(spark)).collect()
    assert sorted(str((r.doc_id, r.nr, r.length, r.sha256, round(r.score, 4), r.secret)) for r in own) == plain_scan(spark, model, odd)


def test_long_values_are_redacted_whole(spark, votes):
    value = "Xk9!?" * 70 + "ENDSECRET"
    phrase = " ".join(["tremble", "otter", "candle", "wix"] * 10)
    docs = spark.createDataFrame([(1, f"password = {value} end"), (2, f'passphrase = "{phrase}" end'), (3, f"pwd={'aB3$,' * 30000}z9 end")], "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in secrets.redact(docs, votes).collect()}
    assert got == {1: "password = [SECRET] end", 2: 'passphrase = "[SECRET]" end', 3: "pwd=[SECRET] end"}
