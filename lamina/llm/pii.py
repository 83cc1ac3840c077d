"""Surrogates for personal data, made by DataFrame functions alone.

Entities (e-mail addresses, phone, card, social security and account numbers, IP addresses of both versions, names of
persons) are found by one pattern, and family names that were found in a text are then found in it wherever they stand alone.
Each entity becomes one or two keys (a kind and a canonical form: a number's digits, a phone's without its country's
code, an address in lower case, a person's family and full name), and each key one surrogate over the whole corpus, derived from a
secret and the key: so an entity has the same surrogate in any writing and any document, and two
never share one. For the latter, candidates are checked against each other, against those given
before and against all keys that occur; who loses gets a candidate of the next attempt, and after
ATTEMPTS one that holds a digest of the key, which nothing else can equal.

Surrogates fit what they replace: numbers keep separators, the first digit and, of phones, the country's code; cards stay valid
or invalid by their check digit, account numbers get valid ones; e-mail addresses keep their shape, domain
by domain; names keep script and case, and given names their gender. A person's gender is what most titles before the full
name say over the whole corpus, or else the given name; titles stay and are no part of a key.

The secret is the setting spark.lamina.pii.secret; where it is unset each process draws its own, and surrogates
differ from process to process.

Edge cases: null and empty texts, and texts without entities, are unchanged; rows may repeat or have a
null id, each is one row of the result; columns of any name are kept (a column n_entities is replaced).
"""

import secrets

from pyspark.sql import functions as F

from .session import materialize, spread, table

ATTEMPTS = 8
SETTING = "spark.lamina.pii.secret"
_drawn = secrets.token_hex(16)

# Titles with the gender they tell, and given names of each gender, in several languages.
MALE_TITLES = "Mr|Sir|Herr|Monsieur|Señor|Sr|Don|Signor|господин|г-н|κύριος"
FEMALE_TITLES = "Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Mlle|Señora|Sra|Señorita|Doña|Signora|госпожа|г-жа|κυρία"
OTHER_TITLES = "Dr|Prof|Professor|Doctor|Docteur"
CAPITAL_TITLES = "MR|MRS|DR|PROF|HERR|FRAU|MONSIEUR|MADAME|SEÑOR|SEÑORA"
MALE_NAMES = "Ahmed|Alejandro|Andreas|Andrew|Anthony|Antonio|Carlos|Charles|Christopher|Daniel|David|Diego|Dmitri|Edward|Fernando|François|Frank|George|Giovanni|Günter|Hans|Henri|Hiroshi|Ibrahim|Ivan|Jacques|James|Jean|Jiro|John|José|Joseph|Juan|Jürgen|Kenji|Kevin|Klaus|Kumar|Luca|Luis|Manuel|Marco|Mark|Matthew|Michael|Miguel|Mohamed|Mohammed|Nikolai|Omar|Paul|Pedro|Peter|Philippe|Pierre|Raj|Richard|Robert|Sergei|Stefan|Steven|Thomas|Wei|William|Wolfgang|Иван|Пётр|Алексей|Дмитрий|Сергей"
FEMALE_NAMES = "Aisha|Alice|Ana|Angela|Anna|Barbara|Camille|Carmen|Catherine|Charlotte|Chiara|Christine|Claire|Elena|Elizabeth|Emily|Emma|Fatima|Giulia|Hannah|Heike|Helena|Helga|Ingrid|Irina|Isabel|Jennifer|Jessica|Julia|Karen|Katharina|Laura|Li|Linda|Lucía|Margaret|Maria|María|Marie|Mary|Mei|Monika|Nadia|Nancy|Natalia|Olga|Patricia|Petra|Priya|Renate|Rosa|Sabine|Sakura|Sarah|Sofia|Sophie|Susan|Svetlana|Tatiana|Teresa|Ursula|Yuki|Анна|Мария|Ольга|Елена|Наталья"


def _any(*lists):
    """A pattern for any word of some lists, factored by common beginnings, so that a place is tried against few of them."""
    tree = {}
    for word in "|".join(lists).split("|"):
        node = tree
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node):
        parts = [c.replace("-", "\\-") + pattern(node[c]) for c in sorted(node) if c]
        if not parts:
            return ""
        return parts[0] if len(parts) == 1 and "" not in node else f"(?:{'|'.join(parts)}){'?' * ('' in node)}"

    return pattern(tree)


_NOT_IN, _NOT_ON = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_PART = r"\p{Lu}[\p{Ll}\p{M}]+(?:[-'’]\p{Lu}[\p{Ll}\p{M}]+)?"
_CAPITALS = r"\p{Lu}{2,}(?:[-'’]\p{Lu}{2,})?"
_TITLE = rf"{_any(MALE_TITLES, FEMALE_TITLES, OTHER_TITLES)}\.? "
#: All that stands before a name, in any case.
_TITLES = rf"^(?iu:{_TITLE})+"
_HEX = "[0-9A-Fa-f]{1,4}"
#: Calling codes of one and two digits; all others have three.
_CALLING = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"

#: The kinds in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ipv6": rf"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:(?:{_HEX}:){{7}}{_HEX}|{_HEX}(?::{_HEX}){{0,5}}::(?:{_HEX}(?::{_HEX}){{0,5}})?)(?![\w:])",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w+])\d(?:[ -]?\d){12,18}(?!\w)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,5}\)[ .-]?|\d{2,5}[ .-])\d{3,4}[ .-]\d{3,4}(?!\w)|(?<![\w+])\+\d{8,15}(?!\w)|(?<![\w+.,-])[2-9]\d{9}(?![\w-]|[.,]\d)",
    "name": rf"{_NOT_IN}(?:(?:{_TITLE}){{1,3}}{_PART}(?: {_PART})?|(?:{_any(CAPITAL_TITLES)}\.? ){{1,3}}{_CAPITALS}(?: {_CAPITALS})?|{_any(MALE_NAMES, FEMALE_NAMES)} {_PART}|{_any(MALE_NAMES.upper(), FEMALE_NAMES.upper())} {_CAPITALS}){_NOT_ON}",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())

_WORDS = (MALE_TITLES, FEMALE_TITLES, OTHER_TITLES, CAPITAL_TITLES, MALE_NAMES, FEMALE_NAMES, MALE_NAMES.upper(), FEMALE_NAMES.upper())
#: What every text with an entity matches; it is cheap, and spares the others the search for ENTITY.
GATE = rf"[0-9@]|{_NOT_IN}(?=[{''.join(sorted({w[0] for w in '|'.join(_WORDS).split('|')}))}]){_any(*_WORDS)}[. ]"


def _quoted(s):
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _is(kind, s):
    return f"{s} rlike {_quoted('^(?:' + PATTERNS[kind] + ')$')}"


def _is_name(s):
    return f"NOT {s} rlike '[0-9@:]'"


def _bare(s):
    """SQL: a name without its titles."""
    return f"regexp_replace({s}, {_quoted(_TITLES)}, '')"


def keys_of(s):
    """SQL for the keys of a surface form: array<struct<kind, canon, vote>>; of a name, the family's and the person's, with the
    gender that this form tells (m, f or n)."""
    digits = f"regexp_replace({s}, '[^0-9]', '')"
    national = f"""CASE WHEN {s} like '+%' THEN regexp_replace({digits}, '^(?:{_CALLING})', '') WHEN length({digits}) > 10 AND {digits} like '00%' THEN regexp_replace({digits}, '^00(?:{_CALLING})', '')
      WHEN length({digits}) = 11 AND {digits} like '1%' THEN substr({digits}, 2) ELSE {digits} END"""
    phone = f"regexp_replace({national}, '^0+(?=.)', '')"
    bare, low = _bare(s), f"lower({s})"
    script = f"CASE WHEN {bare} rlike '\\\\p{{IsCyrillic}}' THEN 'c' WHEN {bare} rlike '\\\\p{{IsGreek}}' THEN 'g' ELSE 'l' END"
    title = lambda words: f"{s} rlike {_quoted(rf'^(?iu:(?:{OTHER_TITLES})[.]? )*(?iu:{words})[.]? ')}"
    vote = f"CASE WHEN {title(MALE_TITLES)} THEN 'm' WHEN {title(FEMALE_TITLES)} THEN 'f' WHEN {bare} rlike {_quoted(rf'^(?iu:{MALE_NAMES}) ')} THEN 'male name' WHEN {bare} rlike {_quoted(rf'^(?iu:{FEMALE_NAMES}) ')} THEN 'female name' ELSE 'n' END"
    six = lambda at: f"filter(split(CASE WHEN {low} like '%::%' THEN substring_index({low}, '::', {at}) WHEN {at} = 1 THEN {low} ELSE '' END, ':'), x -> x != '')"
    ipv6 = f"array_join(transform(concat({six(1)}, array_repeat('0', 8 - size({six(1)}) - size({six(-1)})), {six(-1)}), x -> lpad(x, 4, '0')), '')"
    one = lambda kind, canon: f"array(named_struct('kind', {kind}, 'canon', {canon}, 'vote', ''))"
    family = f"named_struct('kind', concat('family:', {script}), 'canon', lower(element_at(split({bare}, ' '), -1)), 'vote', '')"
    person = f"named_struct('kind', concat('person:', {script}), 'canon', lower({bare}), 'vote', {vote})"
    return f"""CASE WHEN {_is('email', s)} THEN {one("'email'", low)}
      WHEN {_is('iban', s)} THEN {one("'iban'", f"replace({s}, ' ', '')")}
      WHEN {s} like '%:%' THEN {one("'ipv6'", ipv6)}
      WHEN {_is('ip', s)} THEN {one("'ip'", s)}
      WHEN {_is('ssn', s)} THEN {one("'ssn'", digits)}
      WHEN {_is('card', s)} THEN {one("'card'", digits)}
      WHEN {_is_name(s)} THEN CASE WHEN {bare} like '% %' THEN array({family}, {person}) ELSE array({family}) END
      ELSE {one("'phone'", phone)} END"""


def _stream(secret, key, attempt):
    return f"sha2(concat_ws('|', {_quoted(secret)}, {key}, {attempt}), 512)"


def _byte(stream, i):
    """The i-th of a stream's 64 bytes, from 1, and again from the first after the last."""
    return f"cast(conv(substr({stream}, 2 * (({i}) % 64) + 1, 2), 16, 10) as int)"


def _shaped(s, stream):
    """s with every letter and digit replaced by one of its sort."""
    return f"""array_join(transform(split({s}, ''), (c, i) -> CASE
      WHEN c rlike '[0-9]' THEN cast({_byte(stream, 'i')} % 10 as string)
      WHEN c rlike '[a-z]' THEN char(97 + {_byte(stream, 'i')} % 26)
      WHEN c rlike '[A-Z]' THEN char(65 + {_byte(stream, 'i')} % 26) ELSE c END), '')"""


def _luhn(base):
    """The check digit that completes the digits `base`."""
    d = f"cast(substr({base}, i, 1) as int)"
    total = f"aggregate(sequence(1, length({base})), 0, (a, i) -> a + CASE WHEN (length({base}) - i) % 2 = 0 THEN 2 * {d} - CASE WHEN {d} > 4 THEN 9 ELSE 0 END ELSE {d} END)"
    return f"((10 - {total} % 10) % 10)"


#: Syllables of names in each script, and endings by gender.
_SYLLABLES = {
    "l": ("ba|be|bi|bo|da|de|do|fa|fi|ga|go|ka|ke|la|le|li|lo|ma|me|mi|na|ne|ni|no|ra|re|ri|ro|sa|se|ta|te|ti|va|ve|vi|za|zo", "m:n|f:a|n:l|family:rt"),
    "c": ("ба|бе|ва|ве|ви|га|да|де|ди|за|ка|ко|ла|ле|ли|ма|ме|ми|на|не|ни|ра|ре|ри|ро|са|се|та|те|ти", "m:н|f:ла|n:ль|family:рт"),
    "g": ("βα|βε|γα|γε|δα|δε|ζα|κα|κε|κο|λα|λε|λι|μα|με|μι|να|νε|νι|ρα|ρε|ρι|ρο|σα|σε|τα|τε|τι", "m:ν|f:λα|n:λ|family:ρτ"),
}


def _name(script, stream, attempt):
    """A name of 3 syllables, and one more for each attempt, with an ending by gender (of a family name, its own)."""
    syllables, endings = _SYLLABLES[script]
    n = syllables.count("|") + 1
    body = f"array_join(transform(sequence(1, 3 + {attempt}), i -> element_at(split({_quoted(syllables)}, '[|]'), 1 + {_byte(stream, 'i')} % {n})), '')"
    ends = " ".join(f"WHEN kind {'like' if e[0] == 'family' else '='} {_quoted('family:%' if e[0] == 'family' else f'given:{script}:{e[0]}')} THEN {_quoted(e[1])}" for e in (x.split(":") for x in endings.split("|")))
    return f"concat({body}, CASE {ends} ELSE '' END)"


def surrogate(attempt):
    """SQL for the candidate of an attempt for the columns kind, canon, stream and domain; it is as long as canon for all but names
    and IP addresses."""
    s = "stream"
    host = "regexp_extract(substring_index(canon, '@', -1), '^(.*)([.][^.]+)$', 1)"
    top = "regexp_extract(substring_index(canon, '@', -1), '^(.*)([.][^.]+)$', 2)"
    number = f"concat(substr(canon, 1, 1), substr({_shaped('canon', s)}, 2))"
    base = f"concat(substr(canon, 1, 1), substr({_shaped('canon', s)}, 2, length(canon) - 2))"
    valid = f"cast(right(canon, 1) as int) = {_luhn('substr(canon, 1, length(canon) - 1)')}"
    account = f"substr({_shaped('canon', s)}, 5)"
    value = "CASE WHEN c rlike '[0-9]' THEN cast(c as int) ELSE ascii(c) - 55 END"
    rest = f"aggregate(split(concat({account}, substr(canon, 1, 2), '00'), ''), 0, (a, c) -> (a * CASE WHEN c rlike '[0-9]' THEN 10 ELSE 100 END + {value}) % 97)"
    first = "10" if attempt < ATTEMPTS // 2 else f"1 + {_byte(s, 4)} % 254"  # beyond the private addresses once these are taken
    return f"""CASE kind
      WHEN 'email' THEN concat({_shaped("substring_index(canon, '@', 1)", s)}, '@', {_shaped(host, "domain")}, {top})
      WHEN 'ip' THEN concat({first}, '.', {_byte(s, 1)}, '.', {_byte(s, 2)}, '.', {_byte(s, 3)})
      WHEN 'ipv6' THEN concat('fd', substr({s}, 1, 30))
      WHEN 'card' THEN concat({base}, ({_luhn(base)} + CASE WHEN {valid} THEN 0 ELSE 1 + {_byte(s, 63)} % 9 END) % 10)
      WHEN 'iban' THEN concat(substr(canon, 1, 2), lpad(98 - {rest}, 2, '0'), {account})
      WHEN 'phone' THEN {number} WHEN 'ssn' THEN {number}
      ELSE CASE WHEN kind rlike ':c(:|$)' THEN {_name('c', s, attempt)} WHEN kind rlike ':g(:|$)' THEN {_name('g', s, attempt)} ELSE {_name('l', s, attempt)} END END"""


def surrogates(keys, secret, attempts=ATTEMPTS):
    """kind, canon and surrogate for each of the distinct keys; no two of a kind share one, and none is a key that occurs.

    Kinds of given names share one space with each other for a script, and so do families.
    """
    spark = keys.sparkSession
    space = "regexp_replace(kind, '^(given:.):.*$', '$1')"
    left = keys = materialize(spark, keys.select("kind", "canon", F.expr(space).alias("space")), "keys")
    given = None
    for attempt in range(attempts):
        streams = {"stream": F.expr(_stream(secret, "kind, canon", attempt)), "domain": F.expr(_stream(secret, "'domain', substring_index(canon, '@', -1)", 0))}
        candidate = left.withColumns(streams).withColumn("surrogate", F.expr(surrogate(attempt))).drop("stream", "domain")
        free = candidate.join(keys.select("space", F.col("canon").alias("surrogate")), ["space", "surrogate"], "left_anti")
        if given is not None:
            free = free.join(given, ["space", "surrogate"], "left_anti")
        won = materialize(spark, free.groupBy("space", "surrogate").agg(F.min(F.struct("kind", "canon")).alias("k")).select("space", "surrogate", "k.kind", "k.canon"), "surrogates")
        given = won if given is None else given.unionByName(won)
        left = materialize(spark, left.join(won, ["kind", "canon"], "left_anti"), "keys")
        if not left.limit(1).count():
            return given.select("kind", "canon", "surrogate")
    last = left.withColumn("surrogate", F.expr(f"concat('x', {_stream(secret, 'kind, canon', attempts)})"))
    return given.unionByName(last).select("kind", "canon", "surrogate")


def _rendered(s, keys, found):
    """SQL: the surface form s with the surrogates that the map `found` has for its keys, written as s was."""
    of = lambda k: f"{found}[named_struct('kind', {keys}[{k}].kind, 'canon', {keys}[{k}].canon)]"
    first, upto = of(0), f"length(regexp_replace(substr({s}, 1, i), '[^0-9A-Za-z]', ''))"
    kept = f"(length(regexp_replace({s}, '[^0-9A-Za-z]', '')) - length({first}))"  # of a phone's digits those that are no part of its key
    filled = f"array_join(transform(sequence(1, length({s})), i -> CASE WHEN substr({s}, i, 1) rlike '[0-9A-Za-z]' AND {upto} > {kept} THEN substr({first}, {upto} - {kept}, 1) ELSE substr({s}, i, 1) END), '')"
    bare = _bare(s)
    new = f"concat(CASE WHEN size({keys}) > 1 THEN concat(initcap({of(1)}), ' ') ELSE '' END, initcap({first}))"
    name = f"concat(substr({s}, 1, length({s}) - length({bare})), CASE WHEN {bare} = upper({bare}) THEN upper({new}) ELSE {new} END)"
    six = f"regexp_replace({first}, '(.{{4}})(?=.)', '$1:')"
    return f"""CASE WHEN {keys}[0].kind like 'family%' THEN {name}
      WHEN {first} like 'x%' AND length({first}) = 129 THEN {first}
      WHEN {keys}[0].kind = 'ip' THEN {first}
      WHEN {keys}[0].kind = 'ipv6' THEN CASE WHEN {s} rlike '[A-F]' THEN upper({six}) ELSE {six} END
      WHEN {keys}[0].kind = 'email' THEN CASE WHEN {s} = upper({s}) THEN upper({first}) ELSE {first} END
      ELSE {filled} END"""


def _with_families(found):
    """SQL: ENTITY or, where `found` has names, ENTITY and their family names standing alone, as written and in capitals."""
    family = f"array_distinct(transform(filter({found}, s -> {_is_name('s')}), s -> element_at(split(s, ' '), -1)))"
    forms = f"array_distinct(flatten(transform({family}, f -> array(f, upper(f), initcap(lower(f))))))"
    return f"CASE WHEN exists({found}, s -> {_is_name('s')}) THEN concat({_quoted(ENTITY + '|' + _NOT_IN + '(?:')}, array_join({forms}, '|'), {_quoted(')' + _NOT_ON)}) ELSE {_quoted(ENTITY)} END"


def given_names(pairs):
    """kind and canon of each key that occurs, and those (skind, scanon) of its surrogate: a person's is the given name with the
    gender that most titles, or else the given name, tell."""
    own = F.col("kind").like("person:%")
    count = lambda *votes: F.count(F.when(F.col("vote").isin(*votes), 1))
    votes = pairs.where(own).groupBy("kind", "canon").agg((count("m") - count("f")).alias("titles"), (count("male name") - count("female name")).alias("names"))
    sign = F.coalesce(F.nullif(F.sign("titles"), F.lit(0.0)), F.sign("names"))
    gender = F.when(sign > 0, "m").when(sign < 0, "f").otherwise("n")
    persons = votes.select("kind", "canon", F.concat(F.regexp_replace("kind", "person", "given"), F.lit(":"), gender).alias("skind"), F.substring_index("canon", " ", 1).alias("scanon"))
    return persons.union(pairs.where(~own).select("kind", "canon", F.col("kind"), F.col("canon")).distinct())


def replace(df, text="text", secret=None):
    """df with its entities replaced in column `text`, and their number in n_entities (int)."""
    spark, df = df.sparkSession, spread(df)
    secret = secret or spark.conf.get(SETTING, None) or _drawn
    names = [c for c in df.columns if c != "n_entities"]
    first = F.regexp_extract_all(F.col(text), F.lit(ENTITY), 0)
    has = F.coalesce(F.when(F.col(text).rlike(GATE), F.size(first) > 0), F.lit(False))
    with_pattern = df.where(has).withColumn("__first", first).withColumn("__pattern", F.expr(_with_families("__first")))
    found = F.regexp_extract_all(F.col(text), F.col("__pattern"), 0)
    marked = with_pattern.select(*names, F.md5(F.col(text)).alias("__key"), found.alias("__found"), F.split(F.col(text), F.col("__pattern"), -1).alias("__plain"))
    marked = materialize(spark, marked, "marked")  # the rows with entities alone, so that these are searched once

    surfaces = marked.select("__key", F.explode(F.array_distinct("__found")).alias("s")).distinct()
    pairs = materialize(spark, surfaces.select("__key", F.explode(F.expr(keys_of("s"))).alias("k")).select("__key", "k.*").distinct(), "pairs")
    wanted = materialize(spark, given_names(pairs), "wanted")
    given = surrogates(wanted.select(F.col("skind").alias("kind"), F.col("scanon").alias("canon")).distinct(), secret)
    given = wanted.join(given.select(F.col("kind").alias("skind"), F.col("canon").alias("scanon"), "surrogate"), ["skind", "scanon"]).select("kind", "canon", "surrogate")
    given = materialize(spark, given, "surrogates")
    entry = F.struct(F.struct("kind", "canon"), "surrogate")
    maps = pairs.select("__key", "kind", "canon").distinct().join(given, ["kind", "canon"]).groupBy("__key").agg(F.map_from_entries(F.collect_list(entry)).alias("__map"))
    maps = materialize(spark, maps, "maps")  # read anew, so that a text with a great many copies can be split in the join

    new = F.expr(f"transform(transform(__found, s -> named_struct('s', s, 'k', {keys_of('s')})), x -> {_rendered('x.s', 'x.k', '__map')})")
    joined = marked.join(maps, "__key").withColumn("__new", new)
    whole = F.array_join(F.zip_with("__plain", F.concat("__new", F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    kept = [(whole if c == text else F.col(c)).alias(c) for c in names]
    return joined.select(*kept, F.size("__found").alias("n_entities")).union(df.where(~has).select(*names, F.lit(0).alias("n_entities")))


def op1_surrogates(spark, sf_dir):
    return replace(table(spark, sf_dir, "documents").select("doc_id", "text"))
