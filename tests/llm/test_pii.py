import random
import re

from pyspark.sql import functions as F

from lamina.llm import pii

ROWS = [
    (1, "Write to anna.k7@mail3.example.com or ANNA.K7@MAIL3.EXAMPLE.COM, call +1 (017) 555-7713 now."),
    (2, "Call +1 017 555 7713; card 4539 1488 0343 6467, bad 4539148803436468, from 240.56.125.154."),
    (3, "Mr. John Smith met Mrs Smith and Dr. Olga Petrova; г-жа Иванова wrote. Herr Müller-Lüdenscheidt too."),
    (4, "DE89 3704 0044 0532 0130 00 and 078-05-1120."),
    (5, "nothing 123 here v1.2 2024-01-01 a@b"),
    (6, None), (6, None), (None, ""), (None, "x@y.zz"), (7, "bob1@mail3.example.com x@y.zz x@y.zz"),
]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def iban_and_ssn(text):
    return re.match(r"(DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d) and (\d{3}-\d{2}-\d{4})\.", text).groups()


def replaced(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pii.replace(df, secret="one").orderBy("doc_id").collect()]


def test_one_person_one_name(spark):
    a, b, c, d, e = replaced(
        spark,
        "Mr. Alex Weber met Dr. Alex Weber. Weber left; MR. JOHN SMITH came, and Smith spoke to WEBER.",
        "Frau Dr. Petra Klein and Prof. Alex Weber; Klein nods, the klein word stays.",
        "Ms. Alex Jones is not Mr. Jones. Wei Zhang wrote.",
        "Call 5551234567, +1 555 123 4567, 555 123 4567 or 1-555-123-4567; +49 30 123 4567 is 030 123 4567.",
        "At 2001:db8::1, 2001:0DB8:0:0:0:0:0:1 and fe80::1:2; std::vector, 12:30:45 and a::b stay.",
    )
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Dr\. (\w+) (\w+)\. (\w+) left; MR\. ([A-Z]+) ([A-Z]+) came, and (\w+) spoke to ([A-Z]+)\.", a)
    assert m and m[1] == m[3] and m[1].endswith("n") and m[2] == m[4] == m[5] and m[9] == m[2].upper() and m[8].upper() == m[7]
    assert not re.search("(?i)alex|weber|john|smith", a)
    n = re.fullmatch(r"Frau Dr\. (\w+a) (\w+) and Prof\. (\w+) (\w+); (\w+) nods, the klein word stays\.", b)
    assert n and n[2] == n[5] != "Klein" and (n[3], n[4]) == (m[1], m[2])
    o = re.fullmatch(r"Ms\. (\w+a) (\w+) is not Mr\. (\w+)\. (\w+n) (\w+) wrote\.", c)
    assert o and o[1] != m[1] and o[2] == o[3] and "Zhang" not in c
    p = re.fullmatch(r"Call (\d{10}), \+1 (\d{3} \d{3} \d{4}), (\d{3} \d{3} \d{4}) or 1-(\d{3}-\d{3}-\d{4}); \+49 (\d\d \d{3} \d{4}) is 0(\d\d \d{3} \d{4})\.", d)
    assert p and len({re.sub(r"\D", "", p[k]) for k in range(1, 5)}) == 1 and p[1] != "5551234567" and p[5] == p[6] != "30 123 4567"
    q = re.fullmatch(r"At ([0-9a-f:]{39}), ([0-9A-F:]{39}) and ([0-9a-f:]{39}); std::vector, 12:30:45 and a::b stay\.", e)
    assert q and q[1] == q[2].lower() != q[3]


def test_distinct_and_coreferent_over_a_random_corpus(spark):
    """Every entity of known identity is one surrogate wherever it stands, and no two identities share one."""
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(n)).capitalize()
    people = [(rng.choice(["Mr.", "Mrs."]), word(5), word(7)) for _ in range(40)]
    phones = [f"{rng.randint(200, 999)}{rng.randint(200, 999)}{rng.randint(1000, 9999)}" for _ in range(40)]
    mails = [f"{word(4).lower()}@{word(3).lower()}.org" for _ in range(40)]
    cards = ["4" + "".join(rng.choice("0123456789") for _ in range(15)) for _ in range(20)]
    texts, said = [], []
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 5)):
            k = rng.randrange(5)
            if k == 0:
                t, g, f = rng.choice(people)
                parts.append((rng.choice([f"{t} {g} {f}", f"Dr. {g} {f}", f"{t} Prof. {g} {f}"]), ("person", g, f)))
            elif k == 1:
                p = rng.choice(phones)
                parts.append((rng.choice([p, f"+1 {p[:3]} {p[3:6]} {p[6:]}", f"{p[:3]}-{p[3:6]}-{p[6:]}", f"({p[:3]}) {p[3:6]}-{p[6:]}"]), ("phone", p)))
            elif k == 2:
                m = rng.choice(mails)
                parts.append((rng.choice([m, m.upper()]), ("mail", m)))
            elif k == 3:
                c = rng.choice(cards)
                parts.append((rng.choice([c, " ".join(c[i : i + 4] for i in range(0, 16, 4))]), ("card", c)))
            else:
                parts.append((f"10{rng.randrange(10)}", None))
        texts.append("".join(f"und {x} ; " for x, _ in parts))
        said.append(parts)
    seen = {}
    for text, parts in zip(replaced(spark, *texts), said):
        pieces = [x.removeprefix("und ") for x in text.split(" ; ")[:-1]]
        assert len(pieces) == len(parts)
        for new, (old, who) in zip(pieces, parts):
            if who is None:
                assert new == old
                continue
            form = {"person": lambda x: tuple(x.split()[-2:]), "phone": lambda x: re.sub(r"\D", "", x)[-10:], "mail": str.lower, "card": lambda x: x.replace(" ", "")}[who[0]](new)
            assert seen.setdefault(who, form) == form and re.sub(r"\w", "x", new).replace("x", "") == re.sub(r"\w", "x", old).replace("x", "")
            assert luhn(form) == luhn(who[1]) if who[0] == "card" else True
    assert len(set(seen.values())) == len(seen) > 100
    assert not set(seen.values()) & {w[1] for w in seen} and len({f[1] for w, f in seen.items() if w[0] == "person"}) == len({w[2] for w in seen if w[0] == "person"})


def test_a_hot_entity_and_copies(spark):
    """One address in a third of all rows, and one text in another third: each row comes back once, all with one surrogate."""
    rows = [(k, f"note {k} to a.b@cd.org" if k % 3 == 0 else "write to a.b@cd.org or Mr. Alex Weber" if k % 3 == 1 else f"nothing in {k}") for k in range(600)]
    out = {r.doc_id: (r.text, r.n_entities) for r in pii.replace(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(out) == 600 and all(out[k] == (t, 0) for k, t in rows if k % 3 == 2)
    mail = out[0][0].removeprefix("note 0 to ")
    assert mail != "a.b@cd.org" and all(out[k] == (f"note {k} to {mail}", 1) for k in range(0, 600, 3))
    assert len({out[k] for k in range(1, 600, 3)}) == 1 and out[1][0].startswith(f"write to {mail} or Mr. ") and out[1][1] == 2


def test_the_secret_is_a_setting(spark):
    df = spark.createDataFrame([(1, "mail a.b@cd.org")], "doc_id long, text string")
    one = pii.replace(df).first().text
    assert one == pii.replace(df).first().text
    spark.conf.set(pii.SETTING, "another")
    try:
        assert pii.replace(df).first().text not in (one, "mail a.b@cd.org")
    finally:
        spark.conf.unset(pii.SETTING)


def test_surrogates_fit_and_corefer(spark):
    df = spark.createDataFrame([(*r, "k") for r in ROWS], "doc_id long, text string, __x string")
    out = pii.replace(df)
    rows = out.collect()
    assert len(rows) == len(ROWS) and out.columns == ["doc_id", "text", "__x", "n_entities"]
    by = {r.doc_id: r for r in rows}
    assert by[5].text == ROWS[4][1] and by[6].text is None and by[5].n_entities == 0
    one, two, three, four, seven = (by[i].text for i in (1, 2, 3, 4, 7))
    low, up = re.match(r"Write to (\S+) or (\S+), call", one).groups()
    assert up == low.upper() and re.fullmatch(r"[a-z]{4}\.[a-z]\d@[a-z]{4}\d\.[a-z]{7}\.com", low) and low != "anna.k7@mail3.example.com"
    assert seven.split("@")[1].split(" ")[0] == low.split("@")[1]  # one domain, one surrogate
    first = re.search(r"\+(\d \(\d{3}\) \d{3}-\d{4}) now", one)[1]
    second = re.match(r"Call \+(\d \d{3} \d{3} \d{4}); card (\d{4} \d{4} \d{4} \d{4}), bad (\d{16}), from (10(?:\.\d+){3})\.", two)
    digits = lambda s: re.sub(r"\D", "", s)
    assert digits(first) == digits(second[1]) != "10175557713" and digits(first)[0] == "1"
    assert luhn(digits(second[2])) and not luhn(second[3]) and second[2][0] == second[3][0] == "4"
    m = re.match(r"Mr\. (\w+n) (\w+rt) met Mrs (\w+) and Dr\. (\w+a) (\w+rt); г-жа ([а-яА-Я]+) wrote\. Herr (\w+) too\.", three)
    assert m and m[2] == m[3] and "Smith" not in three and m[6] != "Иванова"
    assert re.sub(r"\D", "", iban_and_ssn(four)[1])[0] == "0"
    iban, ssn = re.match(r"(DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d) and (\d{3}-\d{2}-\d{4})\.", four).groups()
    bare = iban.replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1 and ssn != "078-05-1120"
    assert {r.text for r in rows if r.doc_id is None} == {"", seven.split()[1]} and seven.split()[1] == seven.split()[2]
    other = {r.doc_id: r.text for r in pii.replace(df, secret="other").collect()}
    assert other[1] != one and other[5] == by[5].text
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert pii.replace(df.limit(0)).count() == 0


def test_distinct_in_small_spaces(spark):
    keys = spark.range(90).select(F.lit("email").alias("kind"), F.concat((F.col("id") % 10).cast("string"), F.lit("@a."), F.chr(97 + (F.col("id") / 10).cast("int")), F.lit("a")).alias("canon"))
    tight = spark.range(100).select(F.lit("phone").alias("kind"), F.lpad(F.col("id").cast("string"), 2, "0").alias("canon"))
    rows = pii.surrogates(keys.union(tight), "a secret").collect()
    assert len(rows) == 190 and len({(r.kind, r.surrogate) for r in rows}) == 190
    originals = {r.canon for r in rows}
    assert not any(r.surrogate in originals for r in rows)
