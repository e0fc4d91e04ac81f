"""Operator 3: surrogates for personal data. DataFrame operations only.

Mentions are found by one pattern (e-mail addresses, phone numbers, card numbers, IPv4 addresses, keys and tokens, names after a title).
A mention consists of entities in canonical form: an address in lower case, a number's digits with its country code, a bare secret, and of a name
the first name (with the gender that the title tells) and the surname. An entity's surrogate is drawn from a keyed hash of its kind,
canonical form and attempt, and of nothing else, and is then laid into the mention's own format: case, blanks, brackets and hyphens, a
number with or without its country code. So an entity has one surrogate everywhere, whatever its layout, and "Mr John Smith",
"Mr Smith" and, in a text that has the full name after a title, "John Smith" stay one person (coreference). Surrogates match in kind: digits for digits,
letters of the same script, a valid octet for an octet, a Luhn check digit where the original has one, the country code, first
names whose endings tell the gender. Names are made of syllables, more of them with each attempt, so they don't run out.

Distinctness is checked over the whole corpus, between canonical forms and so for all mentions: where two entities get one surrogate, or a
surrogate is a real entity of the corpus, all but the smallest form (all, in the second case) go to the next attempt, until none collides
or, for a fixed format with less room than the corpus has entities of it, `most` attempts are over.
The attempts of those few are the only table that is joined back; the rest needs no join.

Defined results: a null text stays null; an empty text and texts without entities stay as they are; repeated rows get
the same texts; an empty table gives no row; further columns are kept by `replace`, whatever their names. A first name after a title without a gender
(Dr, Prof) is an entity of its own beside the same name after a title with one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anamnesis.llm.common import discard, fresh, materialize

# Titles with the gender they tell.
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "Г-жа"], "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "Г-н"], "n": ["Dr", "Prof", "Professor"]}
# Letters of syllables by script, and endings of names by script and kind.
SYLLABLES = {"latin": ("bdfghklmnprstvwz", "aeiou"), "cyrillic": ("бвгдзклмнпрстфхш", "аеиоу"), "greek": ("βγδζθκλμνπρστφχψ", "αεηιο")}
ENDINGS = {
    "latin": {"first-f": ["a", "ia", "ina", "ella"], "first-m": ["n", "r", "s", "k"], "first-n": ["y", "e"], "last": ["ler", "man", "sen", "dt"]},
    "cyrillic": {"first-f": ["на", "ия", "ла", "ра"], "first-m": ["н", "р", "с", "к"], "first-n": ["ше", "же"], "last": ["ко", "ич", "ук", "як"]},
    "greek": {"first-f": ["α", "η"], "first-m": ["ος", "ης"], "first-n": ["ι", "ω"], "last": ["ου", "ας"]},
}
# The country codes of one and two digits; all others have three.
COUNTRY = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
TITLE = "|".join(t for side in TITLES.values() for t in sorted(side, key=len, reverse=True))
TITLED = rf"(?:(?:{TITLE})\.? )+"
EMAIL = r"[\p{L}\p{N}._%+-]*[\p{L}\p{N}_%+-]@[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?(?:\.[\p{L}\p{N}-]*[\p{L}\p{N}])+"
SECRET = r"(?i:\b(?:api[_-]?key|secret|token|passw(?:or)?d|access[_-]?key)\b)[\"']?\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_/+-]{12,}|\b(?:AKIA|ghp_|sk-)[A-Za-z0-9]{16,}|\b(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{32,}\b"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"
CARD = r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d]|[.-]\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\d\p{L}])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\d\p{L}])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d]|[.-]\d)"
PART = r"\p{Lu}(?:\p{L}|-(?=\p{L})|['’](?=\p{Lu}))+"
NAME = rf"(?<![\p{{L}}\p{{N}}]){TITLED}{PART}(?: {PART})?"
KINDS = [("email", EMAIL), ("secret", SECRET), ("ip", IP), ("phone", PHONE), ("card", CARD), ("ssn", SSN), ("name", NAME)]
ANY = "|".join(f"(?:{p})" for _, p in KINDS)
#: A quick look that only a text with an entity can pass.
HINT = rf"[0-9@]|(?:{TITLE})\.? |(?i:secret|token|passw|key)"


def let(value: Column, body) -> Column:
    """body of the value, which is worked out once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def kind_of(e: Column) -> Column:
    out = F.lit("name")
    for name, pattern in reversed(KINDS[:-1]):
        out = F.when(e.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def canonical(e: Column, kind: Column) -> Column:
    """The form in which two mentions other than names are the same entity. Numbers that are written without a country code have the American form."""
    digits = F.regexp_replace(e, r"[^0-9]", "")
    phone = F.when(e.startswith("+"), digits).otherwise(F.concat(F.lit("1"), digits))
    secret = F.regexp_extract(e, r"([A-Za-z0-9_/+-]{12,})$", 1)
    return F.when(kind == "email", F.lower(e)).when(kind == "phone", phone).when(kind.isin("card", "ssn"), digits).when(kind == "secret", secret).otherwise(e)


def name_words(e: Column) -> Column:
    """The one or two words of a name after its titles."""
    return F.split(F.regexp_replace(e, rf"^{TITLED}", ""), " ")


def entities_of(e: Column, kind: Column) -> Column:
    """The entities (kind, form) of a mention: of a name its words, else one."""
    first = F.regexp_extract(e, rf"^({TITLE})", 1)
    gender = F.when(first.isin(*TITLES["f"]), "first-f").when(first.isin(*TITLES["m"]), "first-m").otherwise("first-n")

    def of(words: Column) -> Column:
        forms = F.transform(words, lambda w: F.lower(w))
        return F.when(F.size(words) == 2, F.array(entity(gender, forms[0]), entity(F.lit("last"), forms[1]))).otherwise(F.array(entity(F.lit("last"), forms[0])))

    return F.when(kind == "name", let(name_words(e), of)).otherwise(F.array(entity(kind, canonical(e, kind))))


def entity(kind: Column, form: Column) -> Column:
    return F.struct(kind.alias("kind"), form.alias("form"))


def stream(key: str, kind: Column, form: Column, attempt: Column, n: int = 4) -> Column:
    """n * 64 hexadecimal digits that depend on all of its inputs."""
    return F.concat(*(F.sha2(F.concat_ws("\x1f", F.lit(key), kind, form, attempt.cast("string"), F.lit(str(i))), 256) for i in range(n)))


def drawn(text: Column, hexes: Column, keep: str) -> Column:
    """text with each digit and letter drawn anew from hexes (two digits each), same class; what `keep` matches at the start stays."""
    chars = F.split(text, "")
    fixed = F.length(F.regexp_extract(text, keep, 0)) if keep else F.lit(0)

    def one(c: Column, i: Column) -> Column:
        return F.when(i < fixed, c).otherwise(let(F.conv(F.substring(hexes, F.pmod(i * 2, F.lit(254)) + 1, F.lit(2)), 16, 10).cast("int"), lambda r: new(c, r)))

    def new(c: Column, r: Column) -> Column:
        def of(letters: str) -> Column:
            return F.substring(F.lit(letters), F.pmod(r, F.lit(len(letters))) + 1, F.lit(1))

        out = F.when(c.rlike("[0-9]"), of("0123456789")).when(c.rlike("[a-z]"), of("abcdefghijklmnopqrstuvwxyz")).when(c.rlike("[A-Z]"), of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        out = out.when(c.rlike(r"\p{IsCyrillic}"), F.when(c.rlike(r"\p{Lu}"), of("АБВГДЕЖЗИКЛМНОПРСТУФ")).otherwise(of("абвгдежзиклмнопрстуф")))
        out = out.when(c.rlike(r"\p{Ll}"), of("àáâäçèéêíîïñóôöúûü")).when(c.rlike(r"\p{Lu}"), of("ÀÁÂÄÇÈÉÊÍÎÏÑÓÔÖÚÛÜ"))
        return out.otherwise(c)

    return F.array_join(F.transform(chars, one), "")


def luhn(digits: Column) -> Column:
    """The sum of Luhn's test of a string of digits, the last one being the check digit."""
    d = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(d, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def format_like(e: Column, digits: Column) -> Column:
    """digits laid into the places of the digits of e."""
    at = F.transform(F.split(e, ""), lambda c: c.rlike("[0-9]").cast("int"))
    return F.array_join(F.transform(F.split(e, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(digits, F.aggregate(F.slice(at, 1, i + 1), F.lit(0), lambda a, x: a + x), F.lit(1))).otherwise(c)), "")


def name_like(form: Column, kind: Column, hexes: Column, attempt: Column) -> Column:
    """A name in lower case, of the form's script and as many hyphenated parts, with an ending of its kind."""
    letter = lambda letters, at: F.substring(letters, F.pmod(F.conv(F.substring(hexes, F.pmod(at * 4, F.lit(248)) + 1, F.lit(4)), 16, 10).cast("int"), F.length(letters)) + 1, F.lit(1))
    script = lambda of: F.when(form.rlike(r"\p{IsCyrillic}"), of("cyrillic")).when(form.rlike(r"\p{IsGreek}"), of("greek")).otherwise(of("latin"))

    def ending(name: str) -> Column:
        """In Cyrillic, surnames in -a and -ya are of women."""
        out = F.array(*map(F.lit, ENDINGS[name]["last"]))
        for k in ("first-f", "first-m", "first-n"):
            out = F.when(kind == k, F.array(*map(F.lit, ENDINGS[name][k]))).otherwise(out)
        return out if name != "cyrillic" else F.when((kind == "last") & form.rlike("[ая]$"), F.array(F.lit("ова"), F.lit("ина"))).otherwise(out)

    syllables = F.when(kind == "last", 4).otherwise(3) + attempt

    def part(i: Column) -> Column:
        start = i * 17
        made = F.transform(F.sequence(F.lit(0), syllables - 1), lambda j: F.concat(letter(script(lambda n: F.lit(SYLLABLES[n][0])), start + 2 * j), letter(script(lambda n: F.lit(SYLLABLES[n][1])), start + 2 * j + 1)))
        return F.concat(F.array_join(made, ""), let(script(ending), lambda x: F.element_at(x, F.pmod(F.conv(F.substring(hexes, F.pmod(i * 6, F.lit(200)) + 40, F.lit(4)), 16, 10).cast("int"), F.size(x)) + 1)))

    hyphens = F.regexp_extract_all(form, F.lit("[-'’]"), F.lit(0))
    return F.array_join(F.flatten(F.zip_with(F.transform(F.sequence(F.lit(0), F.size(hyphens)), part), hyphens, lambda p, h: F.array(p, F.coalesce(h, F.lit(""))))), "")


def replacement(kind: Column, form: Column, attempt: Column, key: str) -> Column:
    """The canonical form of an entity's surrogate; nothing of a mention's layout has part in it."""
    return let(stream(key, kind, form, attempt), lambda h: made(kind, form, attempt, h))


def made(kind: Column, form: Column, attempt: Column, h: Column) -> Column:
    """The same from the hexadecimal digits h."""
    octet = lambda n: (F.pmod(F.conv(F.substring(h, 1 + 4 * n, 4), 16, 10).cast("int"), F.lit(254)) + 1).cast("string")
    phone = let(F.regexp_extract(form, COUNTRY, 0), lambda c: F.concat(c, drawn(F.substring(form, F.length(c) + 1, F.lit(64)), h, "")))
    card = let(drawn(form, h, ""), lambda body: F.when(F.pmod(luhn(form), F.lit(10)) == 0, checked(F.substring(body, F.lit(1), F.length(body) - 1))).otherwise(body))
    host = F.substring_index(form, "@", -1)
    last = F.substring_index(host, ".", -1)
    longer = F.substring(F.translate(h, "0123456789", "ghijklmnop"), F.lit(1), F.floor(attempt / 4).cast("int"))  # short addresses grow before they run out
    mail = F.concat(drawn(F.substring_index(form, "@", 1), h, ""), longer, F.lit("@"), drawn(F.substring(host, F.lit(1), F.length(host) - F.length(last)), F.sha2(h, 512), ""), last)
    hexed = F.substring(h, F.lit(1), F.length(form))
    secret = F.when(form.rlike(r"^[0-9a-f]{1,256}$"), hexed).when(form.rlike(r"^[0-9A-F]{1,256}$"), F.upper(hexed)).otherwise(drawn(form, h, r"^(?:AKIA|ghp_|sk-)"))
    out = F.when(kind == "email", mail).when(kind == "ip", F.concat_ws(".", *(octet(n) for n in range(4)))).when(kind == "phone", phone).when(kind == "card", card)
    return out.when(kind == "ssn", drawn(form, h, "")).when(kind == "secret", secret).otherwise(name_like(form, kind, h, attempt))


def laid(e: Column, kind: Column, words: Column, outs: Column) -> Column:
    """The surrogates of a mention's entities in the mention's format."""
    out = outs[0]
    digits = F.when((kind == "phone") & ~e.startswith("+"), F.substring(out, F.lit(2), F.length(out))).otherwise(out)
    cased = lambda w, o: F.when(w == F.upper(w), F.upper(o)).otherwise(capital(o))
    name = F.concat(F.regexp_extract(e, rf"^{TITLED}", 0), F.array_join(F.zip_with(words, outs, cased), " "))
    secret = F.concat(F.regexp_extract(e, r"(?s)^(.*?)[A-Za-z0-9_/+-]{12,}$", 1), out)
    plain = F.when(kind == "email", F.when(e == F.upper(e), F.upper(out)).otherwise(out)).when(kind == "ip", out).when(kind == "secret", secret)
    return plain.when(kind == "name", name).otherwise(format_like(e, digits))


def capital(word: Column) -> Column:
    """Capitals at the start and after hyphens."""
    one = lambda p: F.concat(F.upper(F.substring(p, F.lit(1), F.lit(1))), F.substring(p, F.lit(2), F.length(p)))
    return F.array_join(F.transform(F.split(word, "(?<=[-'’])"), one), "")


def checked(head: Column) -> Column:
    """head with Luhn's check digit."""
    return F.concat(head, F.pmod(F.lit(10) - F.pmod(luhn(F.concat(head, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string"))


def found_in(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, form): each distinct entity of the corpus."""
    each = docs.select(F.explode_outer(found_in(F.col(text))).alias("e")).where(F.col("e").isNotNull())
    return each.select(F.explode(let(F.col("e"), lambda e: entities_of(e, kind_of(e)))).alias("x")).select("x.kind", "x.form").distinct()


def attempts(found: DataFrame, key: str, most: int = 30) -> DataFrame | None:
    """(kind, form, attempt) of the entities whose first surrogate collides; None if none does."""
    kind, form = F.col("kind"), F.col("form")
    state = found.select("kind", "form", F.lit(0).alias("attempt"))
    moved = False
    real = found.select("kind", F.col("form").alias("out"), F.lit(True).alias("real"))
    for _ in range(most):
        made = materialize(state.withColumn("out", replacement(kind, form, F.col("attempt"), key)), "made")
        first = made.groupBy("kind", "out").agg(F.min("form").alias("first"), F.count("*").alias("n")).where("n > 1")
        bad = made.join(first, ["kind", "out"], "left").join(real, ["kind", "out"], "left")
        hit = F.coalesce(F.col("real"), F.lit(False)) | (F.col("n").isNotNull() & (form != F.col("first")))
        again = materialize(bad.select("kind", "form", (F.col("attempt") + hit.cast("int")).alias("attempt"), hit.alias("hit")), "attempts")
        discard(made)
        if not again.where("hit").head(1):
            break
        moved, state = True, again.drop("hit")
    return state.where("attempt > 0").select("kind", "form", "attempt") if moved else None


def rewritten(text: Column, key: str, tried: Column | None) -> Column:
    """text with its entities replaced. tried: map of kind and form to attempt, for those past the first."""

    def attempt(x: Column) -> Column:
        return F.lit(0) if tried is None else F.coalesce(F.try_element_at(tried, F.concat(x["kind"], F.lit("\x1f"), x["form"])), F.lit(0))

    def outs(e: Column, kind: Column) -> Column:
        return F.transform(entities_of(e, kind), lambda x: replacement(x["kind"], x["form"], attempt(x), key))

    def one(e: Column) -> Column:
        """(surrogate, bare, bare surrogate) of a mention; the last two are the full name without its title, for names of two words."""

        def told(kind: Column, words: Column, new: Column) -> Column:
            full = (kind == "name") & (F.size(words) == 2)
            bare = F.when(full, F.array_join(words, " "))
            return let(laid(e, kind, words, new), lambda out: F.struct(out.alias("out"), bare.alias("bare"), F.when(full, F.regexp_replace(out, rf"^{TITLED}", "")).alias("other")))

        return let(kind_of(e), lambda kind: let(name_words(e), lambda words: let(outs(e, kind), lambda new: told(kind, words, new))))

    def mixed(gaps: Column, found: Column) -> Column:
        """Gap, surrogate, gap, surrogate, ..., gap."""
        full = F.array_distinct(F.filter(found, lambda x: x["bare"].isNotNull()))
        again = lambda g: F.aggregate(full, g, lambda at, x: F.regexp_replace(at, F.concat(F.lit(r"(?<!\p{L})"), x["bare"], F.lit(r"(?!\p{L})")), x["other"]))
        return F.array_join(F.flatten(F.zip_with(gaps, found, lambda g, x: F.array(again(g), F.coalesce(x["out"], F.lit(""))))), "")

    new = let(F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), one), lambda found: mixed(F.split(text, ANY, -1), found))
    return F.when(text.rlike(HINT), new).otherwise(text)


def replace(docs: DataFrame, key: str, text: str = "text", extra: bool = False) -> DataFrame:
    """docs with surrogates in place of entities; with `extra`, n_entities besides."""
    found = materialize(entities(docs, text), "entities")
    tried = attempts(found, key)
    count = [F.size(found_in(F.coalesce(F.col(text), F.lit("")))).cast("long").alias("n_entities")] if extra else []
    if tried is None:
        return docs.select(*(rewritten(F.col(c), key, None).alias(c) if c == text else F.col(c) for c in docs.columns), *count)
    # The few texts with a colliding entity get a map of attempts by their digest.
    digest, known = fresh(docs, "digest", "known")
    own = docs.select(F.sha2(F.col(text), 256).alias(digest), F.explode(found_in(F.coalesce(F.col(text), F.lit("")))).alias("e")).distinct()
    own = own.select(digest, F.explode(let(F.col("e"), lambda e: entities_of(e, kind_of(e)))).alias("x")).select(digest, "x.kind", "x.form").distinct()
    maps = own.join(tried, ["kind", "form"]).groupBy(digest).agg(F.map_from_entries(F.collect_list(F.struct(F.concat("kind", F.lit("\x1f"), "form"), "attempt"))).alias(known))
    met = docs.withColumn(digest, F.sha2(F.col(text), 256)).join(materialize(maps, "tried"), digest, "left")
    done = rewritten(F.col(text), key, F.coalesce(known, F.create_map().cast("map<string,int>")))
    return met.select(*(done.alias(c) if c == text else F.col(c) for c in docs.columns), *count)
