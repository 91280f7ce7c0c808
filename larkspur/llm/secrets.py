"""Secret scans: candidates by pattern, judged by a random forest.

A candidate is a run of 16 or more characters that tokens are made of, with a digit in it; or,
with or without a digit, a value of 6 or more characters after a key word and = or :, up to
the closing quote, if any; or the password of user:password@host.
Most are harmless (digests, identifiers, paths, numbers). A forest trained on labelled
findings decides from length, character transitions and classes, coverage by dictionary
words, whether it is part of a path, and the words beside it. The trained trees become one
SQL expression, so that a text is scanned, judged and redacted inside its own row: no
shuffle, no Python and no row per candidate on the way.

Labelled findings are (before, candidate, after, label); at most MAX_FINDINGS are fitted.
``labelled_findings`` makes such a list by rule, for want of a labelled table.

Defined results: a null text has no candidates and stays null; an empty one stays empty;
every candidate of a long text is judged, whole whatever its length, with CONTEXT characters on either
side of it, but none beyond another candidate; a key word counts up to 24 characters of its name before the = or :,
the user's name before a password up to 64; repeated rows are scanned each on its own; an empty table gives an empty
result; other columns are neither read nor changed, whatever their names.
"""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import names

KEY_WORDS = "secret|token|passw|passphrase|pwd|api|auth|credential|bearer|private|key|(?<![a-z])pin(?![a-z])"
RUN = r"(?<![A-Za-z0-9+/_.\-])(?=[A-Za-z+/_.\-]*[0-9])[A-Za-z0-9+/_.\-]{16,}={0,2}"
#: Where a value begins. One character decides in most places; the key word is looked for last.
AFTER_KEY_WORD = (
    r"(?<=[=:>\s\"'`])(?<=[=:>][ \t]{0,3}[\"'`]?|(?i:bearer|basic) )"
    rf"(?<=(?i:{KEY_WORDS})[A-Za-z0-9_\-]{{0,24}}[\"'`\]]{{0,2}}[ \t]{{0,3}}[=:]{{1,2}}[=>]?[ \t]{{0,3}}(?i:(?:bearer|basic) )?[\"'`]?)"
    r"(?![A-Za-z][A-Za-z0-9+.\-]*://)"
)
#: A quoted value may have spaces; one with a RUN in it is left to the others.
QUOTED = "|".join(rf"(?<={q})(?![^{q}\r\n]*[A-Za-z0-9+/_.\-]{{16}})[^{q}\r\n]{{6,}}(?={q})" for q in ("\"", "'", "`"))
#: A value without spaces ends before another name=, a tag, or a RUN in brackets or after ? | = or :.
PLAIN = r"[^\s\"'`<>&,;(\[{?=|:]"
BREAK = r"(?:[&,;](?![A-Za-z_][A-Za-z0-9_.\-]*[=:])|[(\[{?=|:](?![A-Za-z0-9+/_.\-]{16})|<(?![/A-Za-z!])|>)"
#: What may end a value, and what follows it only if more than that comes: no step is ever taken back.
END = r"(?:[)\]}]|[,;](?![A-Za-z_][A-Za-z0-9_.\-]*[=:]))"
INNER = r"(?:[^\s\"'`<>&,;(\[{?=|:)\]}]|&(?![A-Za-z_][A-Za-z0-9_.\-]*[=:])|[(\[{?=|:](?![A-Za-z0-9+/_.\-]{16})|<(?![/A-Za-z!])|>)"
VALUE = rf"(?![,;)\]}}])(?=(?:{PLAIN}|{BREAK}){{6}})(?:{INNER}|{END}++(?={INNER}))++"
PASSWORD = r"(?<=:)(?<=(?:://|(?<![^\s\"'=(]))[A-Za-z0-9_.%+\-]{0,64}:)[^\s/\"'<>]{3,}(?=@[A-Za-z0-9\[])"
CANDIDATE = f"{PASSWORD}|{AFTER_KEY_WORD}(?:{QUOTED}|{VALUE})|{RUN}"
CONTEXT = 40
MAX_FINDINGS = 4000
TREES, DEPTH = 15, 8
MARK = "[SECRET]"
#: Words that count for dictionary coverage, of candidates in lower case.
DICTIONARY = (
    "the and ing tion ment able ible for with that this from have not you are was one all example sample test data file index page image "
    "static assets content upload user admin name date time year month version release build model report table number home docs blog news "
    "html json text http https www com org net img src lib bin usr var tmp log"
).split()
#: Names right before = or : of which the values are rarely anything else.
PASS_WORDS = "passw|passphrase|pwd|secret|token|api_?-?key|(?<![a-z])pin(?![a-z])"
#: What stands for a value: words of forms and code.
REFERENCE = "^(required|optional|string|integer|boolean|enabled|disabled|default|hidden|redacted|missing|invalid|undefined|unknown|expired|password|secret|token)[.!?]?$|^[*.x-]+$|^[$%<{\\\\[(]|[(){}]|^[a-z_]+([.][a-z_]+)+$"
BENIGN_WORDS = "sha|md5|commit|checksum|digest|hash|uuid|isbn|etag|revision|phone|card|account|order|invoice|tracking|serial|version"
PLACEHOLDERS = "example|sample|dummy|placeholder|changeme|your|fake|xxxx|0000|1234567"
#: How issued tokens begin, in lower case.
PREFIXES = "akia|asia|gh[opsu]_|github_pat_|sk_live_|sk_test_|xox[abeprs]-|glpat-|aiza|eyj"
#: Frequent pairs of letters: names and paths are made of them, random characters are not.
PAIRS = "th|he|an|er|in|on|re|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce"
FEATURES = ("length", "runs", "digits", "upper", "hex", "distinct", "coverage", "path", "key_word", "assigned", "placeholder", "benign", "separators", "prefix", "pairs", "pass_word", "reference", "letters", "spaces", "special", "user")


def _features(c: str, before: str, after: str) -> list[str]:
    """SQL of FEATURES for a candidate and what stands beside it."""
    share = lambda chars: f"1D - length(regexp_replace({c}, '[{chars}]', '')) / length({c})"
    beside = f"lower(concat({before}, ' ', {after}))"
    classes = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '[^A-Za-z0-9]', '-'), '[A-Z]+', 'A'), '[a-z]+', 'a'), '[0-9]+', '0')"
    return [
        f"cast(length({c}) as double)",
        f"cast(length({classes}) as double) / length({c})",
        share("0-9"),
        share("A-Z"),
        share("0-9a-fA-F"),
        f"cast(size(array_distinct(split({c}, ''))) as double) / least(length({c}), 40)",
        f"1D - length(regexp_replace(lower({c}), '{'|'.join(sorted(DICTIONARY, key=len, reverse=True))}', '')) / length({c})",
        f"cast(length(regexp_replace({c}, '[^/]', '')) + if({before} rlike '(/|://|www)$', 2, 0) + if({c} rlike '[.][a-z]{{2,4}}$', 1, 0) as double)",
        f"if(lower({before}) rlike '({KEY_WORDS})', 1D, 0D)",
        f"if({before} rlike '[=:]\\\\s*[\"\\']?$', 1D, 0D)",
        f"if(lower({c}) rlike '({PLACEHOLDERS})' or {beside} rlike '(example|sample|dummy|placeholder|changeme|fake)', 1D, 0D)",
        f"if(lower({before}) rlike '({BENIGN_WORDS})[^=]*$', 1D, 0D)",
        share("_./+\\\\-"),
        f"if(lower({c}) rlike '^({PREFIXES})', 1D, 0D)",
        f"1D - length(regexp_replace(lower({c}), '{PAIRS}', '')) / length({c})",
        f"if(lower({before}) rlike '({PASS_WORDS})[a-z0-9_-]*[^a-z0-9]*$', 1D, 0D)",
        f"if(lower({c}) rlike '{REFERENCE}', 1D, 0D)",
        f"if({c} rlike '^([A-Z]?[a-z]+|[A-Z]+)$', 1D, 0D)",
        f"cast(length({c}) - length(replace({c}, ' ', '')) as double)",
        share("^A-Za-z0-9 _./+\\\\-"),
        f"if({before} rlike ':$' and {after} like '@%', if({before} rlike '://[^ ]*$' or not lower({before}) rlike '(mail|mailto|cc|to|from):$', 1D, 0D), 0D)",
    ]


#: What stands before secrets: half of them with a key word, half without.
BESIDE_KEY_WORD = ("token = \"", "api_key: ", "secret='", "password=", "Authorization: Bearer ", "private_key = ", "auth: \"", "TOKEN = \"", "credential := ", "?token=", "-----BEGIN RSA PRIVATE KEY-----\n")
WITHOUT_KEY_WORD = ("", "", " ", " ", "\n", "- ", "* ", "| ", "1. ", "(", "\"", "'", "use ", "id: ", "aws access id: ", "DATABASE_URL = \"", "value: \"", "x = '", "export AWS=", "?id=", "&sig=", "https:", "Set-Cookie: sid=")


def labelled_findings(n: int = 2000, seed: int = 1) -> list[tuple[str, str, str, float]]:
    """``n`` made findings (before, candidate, after, label), half of them secrets.

    A key word stands before half of the secrets and before a quarter of what is harmless,
    so that it is evidence but not the answer.
    """
    rng = random.Random(seed)
    low, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    syllables = "an er in on re ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 5)))
    words = lambda k: " ".join(word() for _ in range(k))
    any_case = low + low.upper() + digits

    def secret() -> str:
        kind = rng.randrange(8)
        s = [
            lambda: pick("0123456789abcdef", rng.choice((32, 40, 40, 48, 64))),
            lambda: pick(any_case + "+/", rng.choice((32, 40, 44))),
            lambda: "AKIA" + pick(low.upper() + digits, 16),
            lambda: rng.choice(("ghp_", "sk_live_", "xoxb-", "glpat-")) + pick(any_case, rng.randint(24, 40)),
            lambda: pick(any_case, rng.randint(20, 36)),
            lambda: pick(any_case + "_-", rng.randint(24, 48)),
            lambda: f"eyJ{pick(any_case, rng.randint(16, 34))}.eyJ{pick(any_case + '_-', rng.randint(30, 120))}.{pick(any_case + '_-', 43)}",
            lambda: pick(any_case + "+/", 64),
        ][kind]()
        return s if re.search("[0-9]", s) else s[:-1] + "7"

    def short_secret() -> tuple[str, str, str]:
        """(before, candidate, after) of passwords, PINs, phrases and keys of letters."""
        k = rng.randrange(7)
        name = rng.choice(("password", "passwd", "pwd", "secret", "DB_PASSWORD", "user_password", "client_secret", "api_key", "token"))
        to, end = rng.choice(((" = \"", "\" "), ("='", "' "), (": ", " "), ("=", "\n"), ("\": \"", "\", "), (":", " "), (": '", "'\n")))
        if k == 0:
            return name + to, word()[:6].capitalize() + pick(digits, rng.randint(1, 4)) + pick("!@#$%^*", rng.randint(1, 2)), end
        if k == 1:
            return name + to, pick(any_case, rng.randint(7, 15)), end
        if k == 2:
            return rng.choice(("PIN", "pin", "pwd", "password")) + to, pick(digits, rng.choice((6, 6, 8))), end
        if k == 3:
            return name + to, pick(rng.choice((low, low + low.upper())), rng.randint(12, 32)), end
        if k == 4:
            return rng.choice(("passphrase = \"", "password: \"", "secret = \"")), words(rng.randint(3, 5)) + " " + pick(low, 3), "\" "
        if k == 5:
            return rng.choice(("password", "passwd", "pwd", "DB_PASSWORD")) + to, (word() + word())[:12] + rng.choice(("", "", "7", "!")) + pick(low, 2), end
        return f"{rng.choice(('postgres', 'https', 'mysql', 'amqp', 'ftp'))}://{word()}:", rng.choice((pick(any_case, rng.randint(6, 14)), pick(low, 8), word() + pick(digits + "!$", 3))), f"@{word()}.example.org/"

    def short_harmless() -> tuple[str, str, str]:
        """(before, candidate, after) of other values after a key word and = or :."""
        k = rng.randrange(6)
        if k == 0:
            return rng.choice(("author: ", "Author: ", "key: ", "keyword: ", "keywords: ", "tokenizer: ", "api: ", "authority: ", "private: ")), rng.choice((str.capitalize, str.lower))(word() + rng.choice(("an", "er", "ing"))) + "est", rng.choice((" ", ". ", "\n"))
        if k == 1:
            name = rng.choice(("password", "token", "secret", "api_key", "auth", "key"))
            return name + rng.choice((": ", " = ", "=")), rng.choice(("required", "optional", "string", "undefined", "disabled", "invalid", "********", "${DB_PASSWORD}", "$PASSWORD", "<password>", "getpass()", "self.password", "config.token", "request.form.password", "{{ secret }}".replace(" ", ""), "get_token(user)")), rng.choice((" ", "\n"))
        if k == 2:
            return rng.choice(("author: \"", "key: \"", "keywords = '", "api: \"", "authors: \"")), words(rng.randint(2, 6)) + " the", rng.choice(("\" ", "' "))
        if k == 3:
            return rng.choice(("api: ", "key: ", "api_version: ", "auth_date=")), rng.choice((f"20{rng.randint(10, 26)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", f"v{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}", f"{word()}_{word()}_{word()}")), " "
        if k == 4:
            return rng.choice(("mailto:", "email:", "to:", "cc:")), word() + word() + pick(low, 2), f"@{word()}.example.org "
        return rng.choice(("key: ", "private=", "authors: ", "api: ")), f"/{word()}/{word()}/{word()}.{rng.choice(('html', 'py', 'txt'))}", " "

    def harmless() -> tuple[str, str]:
        k = rng.randrange(9)
        if k == 0:
            return rng.choice((" card ", " phone ", " ", " account no. ", " order ")), pick(digits, rng.randint(16, 22))
        if k == 1:
            return rng.choice((" sha1: ", " commit ", " md5 ", " checksum ", " digest=", " etag: \"")), pick("0123456789abcdef", rng.choice((32, 40, 64)))
        if k == 2:
            return rng.choice((" uuid ", " id ", " ")), "-".join(pick("0123456789abcdef", m) for m in (8, 4, 4, 4, 12))
        if k == 3:
            return rng.choice((" see ", " //host", " file ")), "/".join(["", *[word() for _ in range(rng.randint(2, 5))], f"{word()}{rng.randint(1, 99)}.{rng.choice(('html', 'png', 'py', 'js'))}"])
        if k == 4:
            return " ", f"{word()}-{word()}-{rng.randint(1, 9999)}-{word()}{word()}"
        if k == 5:
            return rng.choice((" api_key = \"", " token: ", " secret=")), rng.choice(("your-api-key-1234567890", "EXAMPLE0EXAMPLE0EXAMPLE", "xxxxxxxxxxxxxxxx0000", "sample-token-123456789", "changeme-changeme-1"))
        if k == 6:
            return rng.choice((" mail ", " @", " ")), f"{word()}.{word()}{rng.randint(1, 999)}.example.com"
        if k == 7:
            return " version ", f"{word()}_{rng.randint(1, 20)}.{rng.randint(0, 40)}.{rng.randint(0, 99)}-release-build{rng.randint(1, 9)}"
        return " ", "." * rng.randint(10, 30) + str(rng.randint(0, 9)) + "-" * rng.randint(5, 20)

    out = []
    for i in range(n):
        if i % 2:
            before, c, label = rng.choice(BESIDE_KEY_WORD if rng.random() < 0.5 else WITHOUT_KEY_WORD), secret(), 1.0
            before = f"{words(rng.randint(1, 6))} {before}" if rng.random() < 0.85 else before
        else:
            (before, c), label = harmless(), 0.0
            if rng.random() < 0.25:
                before = rng.choice((" token", " api", " secret", " the password", " auth", " private", " key", " credentials:", " api_key =", " token:")) + before
            before = f"{words(rng.randint(1, 6))} {before}" if rng.random() < 0.9 else before.lstrip()
        if rng.random() < 0.4:
            before, c, after = short_secret() if label else short_harmless()
            out.append((f"{words(rng.randint(1, 4))} {before}"[-CONTEXT:], c, after + words(3), label))
            continue
        if rng.random() < 0.15:
            before, c = before.upper(), c.upper()
        out.append((before[-CONTEXT:], c, rng.choice(("\" ", "' ", " ", "\n", ". ", "")) + words(3), label))
    return out


def train(spark: SparkSession, findings: list[tuple[str, str, str, float]] | None = None, trees: int = TREES, depth: int = DEPTH, seed: int = 17) -> str:
    """Fit the forest; SQL of the mean share of secrets in the leaves that the features ``f`` (array)
    reach: the probability that the model itself gives."""
    model = fitted(spark, findings, trees, depth, seed)
    return "(" + " + ".join(_sql(tree._java_obj.rootNode()) for tree in model.trees) + f") / {len(model.trees)}"


def fitted(spark: SparkSession, findings: list[tuple[str, str, str, float]] | None = None, trees: int = TREES, depth: int = DEPTH, seed: int = 17):
    """The forest of Spark's machine learning library, on at most MAX_FINDINGS findings."""
    from pyspark.ml.classification import RandomForestClassifier

    data = featured(spark, (findings if findings is not None else labelled_findings(MAX_FINDINGS))[:MAX_FINDINGS])
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=64).fit(data)


def featured(spark: SparkSession, findings: list[tuple[str, str, str, float]]) -> DataFrame:
    """(f, features, label) of findings: the features as an array and as a vector."""
    from pyspark.ml.functions import array_to_vector

    data = spark.createDataFrame(findings, "before string, c string, after string, label double").coalesce(1)
    data = data.select(F.expr("array(" + ", ".join(_features("c", "before", "after")) + ")").alias("f"), "label")
    return data.withColumn("features", array_to_vector("f"))


def _sql(node) -> str:
    """The nested conditions of a tree's node; a leaf is the share of secrets in it."""
    if node.getClass().getSimpleName() == "LeafNode":
        stats = node.impurityStats().stats()
        return f"{stats[1] / (stats[0] + stats[1])!r}D"
    yes, no = _sql(node.leftChild()), _sql(node.rightChild())
    return yes if yes == no else f"if(f[{node.split().featureIndex()}] <= {float(node.split().threshold())!r}D, {yes}, {no})"


def with_findings(docs: DataFrame, score: str) -> tuple[DataFrame, str, str]:
    """``docs`` with two columns more, and their names: the text between candidates, and an array of
    (c, score, secret) in the order of the text. A secret is more likely one than not."""
    gaps, cut, found = names.free(docs.columns, "s_gaps", "s_cut", "s_found")
    own = [F.col(f"`{c}`") for c in docs.columns]
    literal = CANDIDATE.replace("\\", "\\\\").replace("'", "\\'")
    split = docs.select(*own, F.expr(f"split(text, '{literal}', -1)").alias(gaps), F.expr(f"regexp_extract_all(text, '{literal}', 0)").alias(cut))
    let = lambda value, name, body: f"transform(array({value}), {name} -> {body})[0]"
    judged = let(f"right(get({gaps}, i), {CONTEXT})", "b", let(f"left(get({gaps}, i + 1), {CONTEXT})", "a", let("array(" + ", ".join(_features("c", "b", "a")) + ")", "f", score)))
    every = f"transform(transform({cut}, (c, i) -> struct(c as c, {judged} as score)), x -> struct(x.c as c, x.score as score, x.score > 0.5D as secret))"
    return split.select(*own, gaps, F.expr(every).alias(found)), gaps, found


def scan(docs: DataFrame, score: str) -> DataFrame:
    """One row per candidate: doc_id, nr (from 0), length, sha256, score, secret."""
    rows, _, found = with_findings(docs.select("doc_id", "text"), score)
    return rows.select("doc_id", F.posexplode(found).alias("nr", "x")).selectExpr(
        "doc_id", "nr", "length(x.c) as length", "sha2(x.c, 256) as sha256", "round(x.score, 6) as score", "x.secret as secret"
    )


def redact(docs: DataFrame, score: str, mark: str = MARK) -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by ``mark``, and ``n_chars``, if there, counted again."""
    rows, gaps, found = with_findings(docs, score)
    clean = f"""if(exists({found}, x -> x.secret), array_join(transform({gaps}, (g, i) ->
        concat(g, coalesce(if(get({found}, i).secret, '{mark}', get({found}, i).c), ''))), ''), text)"""
    out = rows.withColumn("text", F.expr(f"if(text is null, null, {clean})"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.exists(found, lambda x: x.secret), F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), train(spark))
