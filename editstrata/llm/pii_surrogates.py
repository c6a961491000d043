"""Personal data replaced by surrogates: keyed, type-consistent, distinct and the same for every mention.

Columns and SQL functions only. One pattern finds e-mail, IPv4 and IPv6 addresses, phone, card and social security
numbers, IBANs, secrets and keys, and names after a title; cards and IBANs count only with right check digits. In a text
with a titled name, other mentions of that person, family or given name without the title are found too. Each distinct
entity, in a normal form that mentions of
other spelling share, gets a surrogate from a keyed hash: of the same type, with the
entity's format, script and, for names, gender. Surrogates that two entities
share, that equal a real entity, or that were given before are drawn anew until all are distinct.

A name is up to four words after the title, in capitals or not: initials, given names, particles such as "van der", and a family name; words may have hyphens, apostrophes
and capitals inside, and a possessive 's stays behind the surrogate. The last word is the family name, with a surrogate of its own that all who bear it share.
Given names are drawn by person, so that persons of one family stay distinct; initials alone are moved along the alphabet by a step of the family's. Particles, and initials beside
given names, are left out. The gender of a title that tells none (Dr) is that of the same person's other titles in the whole table; a man and a woman of one name are two persons.

A cheap test tells the texts that can hold a mention; only those meet the pattern. Texts with a mention are written once and
shuffled once, all others pass through. A text is cut at its mentions and put together again, so nothing is replaced twice.

Not found: names that no title introduces in their text, postal addresses, dates of birth, numbers without separators other than cards, and
phone numbers of forms other than +country, (area) or 3-3-4 groups and 0-area groups. Two capitalised words after a name (Mr Smith Street) are taken as part of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import fresh, kept, scratch, written

#: Draws until the surrogates must be distinct.
DRAWS = 40
#: Distinct entities up to this number are broadcast to the mentions, more are joined by a shuffle.
BROADCAST_ENTITIES = 50_000

#: Titles by gender (n: any), and given names by gender and script.
TITLES = {"m": ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Господин", "Κύριος"), "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Госпожа", "Κυρία"), "n": ("Dr", "Prof", "Professor")}
GIVEN = {
    ("m", "latin"): ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karim", "Leo", "Marco", "Nils", "Oscar", "Paul"),
    ("f", "latin"): ("Ada", "Bella", "Clara", "Dora", "Emma", "Flora", "Greta", "Hanna", "Ines", "Julia", "Karin", "Lena", "Maria", "Nora", "Olga", "Paula"),
    ("m", "cyrillic"): ("Антон", "Борис", "Виктор", "Денис", "Иван", "Кирилл", "Максим", "Павел"),
    ("f", "cyrillic"): ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Лидия", "Мария", "Ольга"),
    ("m", "greek"): ("Ανδρέας", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος", "Σπύρος", "Χρήστος"),
    ("f", "greek"): ("Άννα", "Βασιλική", "Δήμητρα", "Ελένη", "Ιωάννα", "Κατερίνα", "Μαρία", "Σοφία"),
}
#: Sixteen syllables a script for family names, and sixteen letters for other words.
SYLLABLES = {"latin": ("ba", "de", "fi", "go", "hu", "ka", "le", "mi", "no", "pu", "ra", "se", "ti", "vo", "wa", "ze"), "cyrillic": ("ба", "ве", "ги", "до", "зу", "ка", "ле", "ми", "но", "пу", "ра", "се", "ти", "фо", "ха", "че"), "greek": ("βα", "γε", "δι", "ζο", "θυ", "κα", "λε", "μι", "νο", "πυ", "ρα", "σε", "τι", "φο", "χα", "ψε")}
LETTERS = {"latin": "bcdfghjkmnprstvz", "cyrillic": "абвгдежзиклмнопр", "greek": "αβγδεζηθικλμνξοπ"}
#: First digits of a number that stay; they tell its country or issuer.
KEPT_DIGITS = 1

_WORD = r"\p{L}\p{N}._%+-"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_HEX = "[0-9A-Fa-f]{1,4}"
_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
_UPPER_TITLE = "|".join(sorted((t.upper() for ts in TITLES.values() for t in ts), key=len, reverse=True))
#: Words inside names that are no name.
PARTICLES = "von van der den de del della di da dos das du la le los las ten ter zu zum zur bin ibn al el y af av of".split()
#: A word of a name goes on after a hyphen or an apostrophe, but not into a possessive 's.
_JOINED = r"(?:-\p{L}+|['’](?![sS](?!\p{L}))\p{L}+)*"
_PARTICLE = rf"(?:(?:{'|'.join(PARTICLES)}) )*"
_INITIAL = r"(?:\p{Lu}\.)+"
_NAME = rf"(?!(?:{_TITLE})(?!\p{{L}}))\p{{Lu}}\p{{L}}+{_JOINED}|\p{{Lu}}['’]\p{{L}}+{_JOINED}"
_NAMES = rf"(?:(?:{_INITIAL}|{_NAME}) ?(?<=[. ]){_PARTICLE}){{0,3}}{_PARTICLE}(?:{_NAME})"
_UPPER_NAME = r"\p{Lu}{2,}(?:[-'’]\p{Lu}+)*"
_UPPER_NAMES = rf"(?:{_INITIAL} ?)*(?:\p{{Lu}}['’])?{_UPPER_NAME}(?: {_UPPER_NAME})?(?!\p{{L}})"
_TITLED = rf"(?:{_TITLE})\.? {_NAMES}|(?:{_UPPER_TITLE})\.? {_UPPER_NAMES}"
_ANY_TITLE = f"{_TITLE}|{_UPPER_TITLE}"
#: Around a name without a title: no letter or hyphen, and an apostrophe only as a quote or before a possessive s.
_BEFORE, _AFTER = r"(?<![\p{L}\p{N}-])(?<!\p{L}['’])", r"(?![\p{L}\p{N}-]|['’](?![sS](?!\p{L}))\p{L})"
_IN, _OUT = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
IPV6 = rf"(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}"
KEYS = r"AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z-]{20,}"
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?"
PATTERN = "|".join(
    (
        rf"(?<![{_WORD}])[{_WORD}]{{1,64}}@(?:[\p{{L}}\p{{N}}-]{{1,63}}\.){{1,5}}\p{{L}}{{2,24}}",
        rf"(?<![0-9A-Za-z.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9A-Za-z]|\.[0-9])",
        rf"(?<![0-9A-Za-z:])(?:{IPV6})(?![0-9A-Za-z:])",
        r"\+[0-9]{1,3}[ -]?(?:\([0-9]{2,4}\)[ -]?)?[0-9]{2,4}(?:[ -]?[0-9]{2,4}){1,3}(?![0-9])",
        rf"(?<![0-9A-Za-z+-])(?:\([0-9]{{3}}\) ?|[0-9]{{3}}[-. ])[0-9]{{3}}[-.][0-9]{{4}}{_OUT}",
        rf"(?<![0-9A-Za-z+-])(?<![0-9] )[2-9][0-9]{{2}} [0-9]{{3}} [0-9]{{4}}{_OUT}(?! [0-9])",
        rf"(?<![0-9A-Za-z+./-])\(?0[0-9]{{2,4}}\)?[ /-][0-9]{{5,8}}{_OUT}",
        rf"(?<![0-9A-Za-z-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![0-9A-Za-z-])",
        rf"{_IN}[0-9]{{4}}(?:[ -][0-9]{{4}}){{3}}{_OUT}",
        rf"{_IN}[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]{{5}}{_OUT}",
        rf"{_IN}[0-9]{{13,19}}{_OUT}",
        rf"{_IN}(?:{KEYS}){_OUT}",
        rf"{_IN}{IBAN}{_OUT}",
        rf"{_IN}(?=[0-9A-Fa-f]*[0-9])(?:[0-9a-f]{{32,128}}|[0-9A-F]{{32,128}}){_OUT}",
        rf"(?<!\p{{L}})(?:{_TITLED})",
    )
)
#: No text without a match of this has a match of PATTERN.
GATE = "[0-9@]|::|AKIA|gh[pousr]_|sk-"
DIGITS = "0123456789"


def may_mention(text: Column) -> Column:
    """False only for texts without a mention."""
    test = text.rlike(GATE)
    for t in sorted({x for ts in TITLES.values() for t in ts for x in (t, t.upper())}):
        test = test | text.contains(t)
    return F.coalesce(test, F.lit(False))


def _luhn_ok(mention: Column) -> Column:
    return _luhn_sum(_digits(mention)) % 10 == 0


def _mod97(text: Column) -> Column:
    """The remainder of an IBAN whose first four characters stand last, letters as 10 to 35."""
    value = lambda c: F.ascii(c) - F.when(c.rlike("[0-9]"), 48).otherwise(55)
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)


def _iban_ok(mention: Column) -> Column:
    flat = F.replace(mention, F.lit(" "))
    return _mod97(F.concat(F.substr(flat, F.lit(5)), F.substr(flat, F.lit(1), F.lit(4)))) == 1


def type_of(mention: Column) -> Column:
    """email, phone, ip, ipv6, ssn, card, iban, secret or name, by the mention's form; null for numbers whose check digits are wrong, which are left alone."""
    digits = _digits(mention)
    return (
        F.when(mention.contains("@"), "email")
        .when(mention.startswith("+"), "phone")
        .when(mention.rlike(r"^[0-9]+(\.[0-9]+){3}$"), "ip")
        .when(mention.rlike(rf"^(?:{IPV6})$"), "ipv6")
        .when(mention.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when(~mention.rlike("^(000|666|9)|-00-|-0000$"), "ssn"))
        .when(mention.rlike(r"^[0-9 -]{13,23}$") & F.length(digits).between(13, 19), F.when(_luhn_ok(mention) & mention.rlike("^[2-6]"), "card"))
        .when(mention.rlike(r"^[(0-9][0-9() ./-]+$"), "phone")
        .when(mention.rlike(rf"^(?:{KEYS})$") | mention.rlike("^(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})$"), "secret")
        .when(mention.rlike(rf"^{IBAN}$"), F.when(_iban_ok(mention), "iban"))
        .otherwise("name")
    )


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def normal_form(kind: Column, mention: Column) -> Column:
    """What all spellings of one entity share; names have parts of their own."""
    return F.when(kind.isin("email", "ipv6"), F.lower(mention)).when(kind.isin("phone", "card", "ssn"), _digits(mention)).when(kind == "iban", F.replace(mention, F.lit(" "))).when((kind == "secret") & mention.rlike("^[0-9A-Fa-f]+$"), F.lower(mention)).otherwise(mention)


def _stream(key: str, *parts: Column) -> Column:
    """192 hexadecimal digits that depend on the key and the parts."""
    return F.concat(*(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(str(k)), *parts), 256) for k in range(3)))


def _number(stream: Column, at: int, size: int) -> Column:
    return F.conv(F.substring(stream, at, size), 16, 10).cast("long")


def _spelled(text: Column, stream: Column) -> Column:
    """Each digit and letter replaced by one of its kind and script, the rest kept."""
    digits, latin, cyrillic, greek = F.translate(stream, "abcdef", "036925"), *(F.translate(stream, "0123456789abcdef", LETTERS[s]) for s in ("latin", "cyrillic", "greek"))

    def one(c: Column, i: Column) -> Column:
        at = F.pmod(i, F.lit(192)) + 1
        pick = lambda letters: F.when(c == F.lower(c), letters.substr(at, F.lit(1))).otherwise(F.upper(letters.substr(at, F.lit(1))))
        return F.when(c.rlike("[0-9]"), digits.substr(at, F.lit(1))).when(c.rlike(r"\p{IsCyrillic}"), pick(cyrillic)).when(c.rlike(r"\p{IsGreek}"), pick(greek)).when(c.rlike(r"\p{L}"), pick(latin)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn_sum(digits: Column) -> Column:
    """Sum of the digits, every second from the right doubled."""
    d = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(d, F.lit(0), lambda a, x: a + x)


def _family(stream: Column, script: Column, syllables: Column) -> Column:
    pick = lambda k: F.coalesce(*(F.when(script == s, F.element_at(F.array(*map(F.lit, x)), (_number(stream, 4 * k + 1, 4) % 16 + 1).cast("int"))) for s, x in SYLLABLES.items()))
    word = F.concat(pick(0), pick(1), pick(2), F.when(syllables > 3, pick(3)).otherwise(""), F.when(syllables > 4, pick(4)).otherwise(""))
    return F.initcap(word)


def _iban(norm: Column, s: Column) -> Column:
    """Country kept, the account spelled anew, the check digits worked out."""
    country, body = F.substr(norm, F.lit(1), F.lit(2)), _spelled(F.substr(norm, F.lit(5)), s)
    check = F.lpad((98 - _mod97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")
    return F.concat(country, check, body)


def surrogate(key: str, kind: Column, scope: Column, norm: Column, draw: Column) -> Column:
    """The normal form's replacement, itself in normal form. Given names have norms "gender given" and their family as scope."""
    s = _stream(key, kind, scope, norm, draw.cast("string"))
    domain = F.substring_index(norm, "@", -1)
    top = F.concat(F.lit("."), F.substring_index(domain, ".", -1))
    host = _spelled(F.expr("substring_index(norm, '@', -1)").substr(F.lit(1), F.length(domain) - F.length(top)), _stream(key, F.lit("domain"), domain))
    local = F.substring_index(norm, "@", 1)
    email = F.concat(_spelled(local, s), F.when(draw > 4, F.substring(s, 1, 8)).otherwise(""), F.lit("@"), host, top)
    ip = F.concat_ws(".", (_number(s, 1, 4) % 223 + 1).cast("string"), *((_number(s, 1 + 4 * k, 4) % 256).cast("string") for k in (1, 2, 3)))
    ipv6 = F.array_join(F.transform(F.split(norm, ":"), lambda p, i: F.when(p == "", "").otherwise(F.concat(F.substr(F.lit("123456789abcdef1"), F.pmod(_number(s, 1, 4) + i, F.lit(16)).cast("int") + 1, F.lit(1)), F.substr(s, 4 * i + 1, F.length(p) - 1)))), ":")
    digits = F.concat(F.substring(norm, 1, KEPT_DIGITS), F.translate(s, "abcdef", "036925").substr(F.lit(1), F.length(norm) - KEPT_DIGITS))
    body = digits.substr(F.lit(1), F.length(norm) - 1)
    card = F.concat(body, F.pmod(-_luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))
    ssn = F.concat((_number(s, 1, 4) % 565 + 101).cast("string"), F.lpad((_number(s, 5, 4) % 99 + 1).cast("string"), 2, "0"), F.lpad((_number(s, 9, 6) % 9999 + 1).cast("string"), 4, "0"))
    prefix = F.regexp_extract(norm, r"^(AKIA|gh[pousr]_|sk-)", 1)
    secret = F.when(prefix != "", F.concat(prefix, _spelled(F.substr(norm, F.length(prefix) + 1), s))).otherwise(F.substring(s, 1, 192).substr(F.lit(1), F.length(norm)))
    script = F.when(norm.rlike(r"\p{IsCyrillic}"), "cyrillic").when(norm.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    syllables = F.when(draw > 8, 5).when(draw > 2, 4).otherwise(3)
    family = F.when(norm.contains("-"), F.concat_ws("-", _family(s, script, syllables), _family(F.substr(s, F.lit(65)), script, F.lit(3)))).otherwise(_family(s, script, syllables))
    names = {(g, c): sum((GIVEN[h, c] for h in ("m", "f") if g in (h, "n")), ()) for g in ("m", "f", "n") for c in SYLLABLES}
    pick = lambda at: F.coalesce(*(F.when((F.substring(norm, 1, 1) == g) & (script == c), F.element_at(F.array(*map(F.lit, x)), (_number(s, at, 4) % len(x) + 1).cast("int"))) for (g, c), x in names.items()))
    given = F.concat(pick(9), F.when(draw > 4, F.concat(F.lit("-"), pick(13))).otherwise(""), F.when(draw > 12, F.concat(F.lit("-"), pick(17))).otherwise(""))
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "ipv6", ipv6).when(kind == "card", card).when(kind == "iban", _iban(norm, s)).when(kind == "ssn", ssn).when(kind == "phone", digits).when(kind == "secret", secret).when(kind == "given", given).otherwise(family)


def _rendered(kind: Column, mention: Column, replacement: Column) -> Column:
    """The replacement in the mention's format: separators and case."""
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("k"))
    fill = lambda sign: F.aggregate(F.split(mention, ""), start, lambda a, c: F.when(c.rlike(sign), F.struct(F.concat(a["s"], replacement.substr(a["k"] + 1, F.lit(1))).alias("s"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["k"].alias("k"))), lambda a: a["s"])
    shout = (mention == F.upper(mention)) & (mention != F.lower(mention)) & ~mention.rlike("^AKIA")
    return F.when(kind.isin("phone", "card", "ssn"), fill("[0-9]")).when(kind == "iban", fill("[0-9A-Z]")).when(shout, F.upper(replacement)).otherwise(replacement)


def assigned(entities: DataFrame, key: str) -> DataFrame:
    """(kind, scope, norm, replacement) for distinct `entities` (kind, scope, norm): no two of a kind and scope share a replacement, and none is a real entity."""
    with scratch(entities.sparkSession):
        entities = written(entities.distinct(), "entities")
        same = ["kind", "scope"]
        told = F.lower("replacement").alias("told")  # whatever the case, two surrogates are equal
        real = entities.select(*same, F.lower(F.when(F.col("kind") == "given", F.substr("norm", F.lit(3))).otherwise(F.col("norm"))).alias("told"))
        done, left = None, entities.withColumn("draw", F.lit(0))
        for _ in range(DRAWS):
            drawn = left.withColumn("replacement", surrogate(key, F.col("kind"), F.col("scope"), F.col("norm"), F.col("draw")))
            drawn = drawn.withColumn("told", told)
            drawn = written(drawn.withColumn("nth", F.row_number().over(Window.partitionBy(*same, "told").orderBy("norm"))), "drawn")
            good = drawn.filter("nth = 1").join(real, [*same, "told"], "left_anti")
            if done is not None:
                good = good.join(done.select(*same, told), [*same, "told"], "left_anti")
            good = written(good.select(*same, "norm", "replacement"), "good")
            done = good if done is None else written(done.unionByName(good), "done")
            left = written(drawn.join(good, [*same, "norm"], "left_anti").select(*same, "norm", (F.col("draw") + 1).alias("draw")), "left")
            if left.isEmpty():
                return kept(done, "surrogates")
    raise RuntimeError(f"some entities found no surrogate of their own in {DRAWS} draws")


def _words(name: Column) -> Column:
    """The words of a name without its title, in lower case and without particles; initials that stand together are words of their own."""
    plain = F.lower(F.regexp_replace(F.regexp_replace(name, "’", "'"), r"\.(?! )", ". "))
    return F.filter(F.split(F.trim(plain), " +"), lambda w: ~w.isin(*PARTICLES))


def _names(mentions: DataFrame) -> DataFrame:
    """Name mentions (row, pos, mention) with title, given ("gender given", null without one), family, initials and given_only; those without a title take what the text's titled mentions tell."""
    title = F.regexp_extract("mention", rf"^((?:{_ANY_TITLE})\.? )", 1)
    of = lambda g: "|".join(sorted((x for t in TITLES[g] for x in (t, t.upper())), key=len, reverse=True))
    gender = F.coalesce(*(F.when(F.regexp_extract("mention", rf"^(?:{of(g)})\.? ", 0) != "", g) for g in ("m", "f")), F.lit("n"))
    names = mentions.withColumn("title", title).withColumn("words", _words(F.substr("mention", F.length("title") + 1)))
    front = F.slice("words", F.lit(1), F.size("words") - 1)
    givens, initials = F.filter(front, lambda w: ~w.endswith(".")), F.filter(front, lambda w: w.endswith("."))
    names = names.withColumns({"family": F.element_at("words", -1), "givens": givens, "g": F.when(F.size(givens) > 0, F.array_join(givens, " ")), "initials": F.when(F.size(givens) == 0, F.array_join(F.transform(initials, F.upper), " "))})
    titled = names.filter("title != ''").withColumn("gender", gender)
    persons = titled.filter("g is not null")
    sexes = persons.groupBy("g", "family").agg(F.count_if(F.col("gender") == "m").alias("m"), F.count_if(F.col("gender") == "f").alias("f"))
    sexes = sexes.select("g", "family", F.when((F.col("m") == 0) & (F.col("f") == 0), "n").when(F.col("m") >= F.col("f"), "m").otherwise("f").alias("usual"))
    persons = persons.join(sexes, ["g", "family"]).withColumn("sex", F.when(F.col("gender") == "n", F.col("usual")).otherwise(F.col("gender")))
    whole = persons.groupBy("row", "g", "family").agg(F.min_by("sex", "pos").alias("sex"))
    families = titled.select("row", "family").distinct().withColumn("is_family", F.lit(True))
    by_given = persons.select("row", "pos", "sex", "g", "family", F.explode("givens").alias("word")).groupBy("row", F.col("word").alias("family")).agg(F.min_by(F.struct("sex", "g", "family"), "pos").alias("who"))
    own = persons.select("row", "pos", F.col("sex").alias("own_sex"))
    out = names.join(own, ["row", "pos"], "left").join(whole, ["row", "g", "family"], "left").join(families, ["row", "family"], "left").join(by_given, ["row", "family"], "left")
    given_only = (F.col("title") == "") & (F.size("words") == 1) & F.col("is_family").isNull() & F.col("who").isNotNull()
    given = F.when(given_only, F.concat_ws(" ", "who.sex", "who.g")).when(F.col("g").isNotNull(), F.concat_ws(" ", F.coalesce("own_sex", "sex", F.lit("n")), "g"))
    return out.select("row", "pos", "mention", "title", given.alias("given"), F.when(given_only, F.col("who.family")).otherwise(F.col("family")).alias("family"), "initials", given_only.alias("given_only"))


#: The alphabets in which initials are moved.
ALPHABETS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")


def _moved(initials: Column, key: str, family: Column) -> Column:
    """Initials moved along their alphabet by one step for all of a family, so that different ones stay different; letters of no alphabet here become X."""
    step = _number(_stream(key, F.lit("initials"), family), 1, 6)

    def one(c: Column) -> Column:
        at = [F.instr(F.lit(a), c) for a in ALPHABETS]
        moved = [F.substr(F.lit(a + a), at[k] + 1 + (step % (len(a) - 1)).cast("int"), F.lit(1)) for k, a in enumerate(ALPHABETS)]
        return F.when(c.isin(".", " "), c).when(at[0] > 0, moved[0]).when(at[1] > 0, moved[1]).when(at[2] > 0, moved[2]).otherwise(F.lit("X"))

    return F.array_join(F.transform(F.split(initials, ""), one), "")


def _heard(name: Column) -> Column:
    """Patterns for later mentions of a name without its title: the name, its words and their parts, as written and capitalised; no initials or particles."""
    parts = F.concat(F.array(name), F.split(name, " "), F.split(name, "[ -]"))
    parts = F.filter(parts, lambda w: (F.length(w) > 1) & ~w.rlike(r"^\p{L}\.|^\p{L}$") & ~w.isin(*PARTICLES))
    forms = F.array_union(parts, F.transform(F.filter(parts, lambda w: w == F.upper(w)), F.initcap))
    return F.transform(forms, lambda w: F.replace(w, F.lit("."), F.lit("[.]")))


def with_surrogates(documents: DataFrame, *, key: str) -> DataFrame:
    """The rows of `documents` (doc_id, text and others) with text rewritten, and n_entities.

    Mentions of one entity get one surrogate in all documents; different entities get different ones.
    The key alone decides the draws. Null and empty texts stay as they are with
    n_entities 0, texts without a mention stay unchanged. Repeated rows and rows of null doc_id are
    rewritten alike. Other columns are kept, but for n_entities, which is replaced; an empty table gives an empty result.
    """
    columns = [c for c in documents.columns if c != "n_entities"]
    plain = documents.select(*columns)
    all_of = lambda pattern: F.regexp_extract_all("text", pattern, F.lit(0))
    touched = may_mention(F.col("text")) & F.coalesce(F.col("text").rlike(PATTERN), F.lit(False))
    row, pattern, found = (fresh(plain, c) for c in ("row", "pattern", "found"))
    with scratch(documents.sparkSession):
        first = all_of(F.lit(PATTERN))
        word = rf"^(?:{_ANY_TITLE})\.? "
        heard = F.array_distinct(F.flatten(F.transform(F.filter(first, lambda m: m.rlike(word)), lambda m: _heard(F.regexp_replace(m, word, "")))))
        longest = F.array_sort(heard, lambda a, b: F.length(b) - F.length(a))
        bare = F.concat(F.lit(rf"{PATTERN}|{_BEFORE}(?:"), F.array_join(longest, "|"), F.lit(f"){_AFTER}"))
        hits = kept(plain.filter(touched).withColumn(row, F.xxhash64("doc_id", "text")).withColumn(pattern, F.when(F.size(heard) > 0, bare).otherwise(F.lit(PATTERN))).withColumn(found, all_of(F.col(pattern))), "spotted")
        mentions = hits.select(F.col(row).alias("row"), F.col(found).alias("found")).dropDuplicates(["row"]).select("row", F.posexplode("found").alias("pos", "mention")).withColumn("kind", type_of(F.col("mention")))
        mentions = written(mentions.filter("kind is not null").withColumn("norm", normal_form(F.col("kind"), F.col("mention"))), "mentions")
        names = written(_names(mentions.filter("kind = 'name'").select("row", "pos", "mention")), "names")
        none = F.lit("").alias("scope")
        entities = mentions.filter("kind <> 'name'").select("kind", none, "norm").unionByName(names.select(F.lit("family").alias("kind"), none, F.col("family").alias("norm"))).unionByName(names.filter("given is not null").select(F.lit("given").alias("kind"), F.col("family").alias("scope"), F.col("given").alias("norm")))
        table = assigned(entities, key)
        side = F.broadcast(table) if table.count() <= BROADCAST_ENTITIES else table
        others = mentions.filter("kind <> 'name'").join(side.filter("scope = ''"), ["kind", "norm"]).select("row", "pos", _rendered(F.col("kind"), F.col("mention"), F.col("replacement")).alias("new"))
        given = side.filter("kind = 'given'").select(F.col("scope").alias("family"), F.col("norm").alias("given"), F.col("replacement").alias("new_given"))
        family = side.filter("kind = 'family'").select(F.col("norm").alias("family"), F.col("replacement").alias("new_family"))
        initials = F.when(F.col("initials") != "", _moved(F.col("initials"), key, F.col("family")))
        shown = F.when(F.col("given_only"), F.col("new_given")).otherwise(F.concat_ws(" ", "new_given", initials, "new_family"))
        name = F.substr("mention", F.length("title") + 1)
        told = names.join(family, "family").join(given, ["family", "given"], "left").select("row", "pos", F.concat("title", F.when(name == F.upper(name), F.upper(shown)).otherwise(shown)).alias("new"))
        new = others.unionByName(told).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("pos", "new"))).alias("new"))
        new = kept(new, "new")

    by_place = fresh(hits, "new")
    out = hits.join(new.select(F.col("row").alias(row), F.col("new").alias(by_place)), row, "left")
    shown = F.transform(F.col(found), lambda m, i: F.coalesce(F.try_element_at(F.col(by_place), i), m))
    pieces = F.zip_with(F.split("text", F.col(pattern), F.lit(-1)), F.concat(shown, F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    out = out.withColumn("text", F.array_join(pieces, "")).withColumn("n_entities", F.coalesce(F.size(F.map_keys(by_place)), F.lit(0)).cast("long"))
    rest = plain.filter(~touched).withColumn("n_entities", F.lit(0).cast("long"))
    return out.select(*columns, "n_entities").unionByName(rest.select(*columns, "n_entities"))
