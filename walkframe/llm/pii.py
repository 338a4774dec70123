"""Personal data: detection, and keyed surrogates of the same type, with DataFrame functions only.

Every distinct entity is reduced to atoms: the canonical form of a number or key,
the mailbox and the host of an e-mail address, or each part of a person's name. An
atom's surrogate is drawn from SHA-2 of a key, its kind, the atom and an attempt; so
the same person, host or number gets the same surrogate wherever and however it is
written. Where two atoms of a kind would get one surrogate, or an atom that occurs,
all but the first draw again, until every surrogate is distinct; names, hosts and
mailboxes get longer with each draw, numbers after sixteen, so that no format is used
up. The surrogate is then laid out in the entity's own format: separators, letter
case, country code, script, the prefix of a key, check digits of cards and IBANs, and
a given name's gender stay.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from walkframe.session import cut

#: Where the session has the key; without one, a session draws its own, and nobody can rebuild the mapping.
KEY = "spark.walkframe.surrogates.key"

# Patterns, in the order in which they are tried at a position. Repeated groups are bounded: the regular
# expressions of the JVM recurse once for each repetition. A host has at most 127 labels (RFC 1035).
EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++){0,125}\.\p{L}{2,}+"
PREFIX = "AKIA|(?:sk|pk|ghp|gho|xoxb)[-_]"
CREDENTIAL = (
    r"(?<![\p{L}\p{N}_\-])"
    r"(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|AKIA[0-9A-Z]{16}|(?:sk|pk|ghp|gho|xoxb)[-_][0-9A-Za-z_\-]{16,}+)(?![\p{L}\p{N}_\-])"
)
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![\p{L}\p{N}])"
IP = r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\p{L}\p{N}]|\.[0-9])"
SSN = r"(?<![\p{L}\p{N}\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}\-])"
CARD = r"(?<![\p{L}\p{N}+\-.])[0-9](?:[ \-]?[0-9]){12,18}(?![\p{L}\p{N}\-])"
PHONE = (
    r"(?<![\p{L}\p{N}])\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){1,4}(?![\p{L}\p{N}])"
    r"|(?<![\p{L}\p{N}])\([0-9]{3}\)[ .\-]?[0-9]{3}[ .\-][0-9]{4}(?![\p{L}\p{N}])"
    r"|(?<![\p{L}\p{N}\-.])[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}(?![\p{L}\p{N}\-])"
)
#: The country codes of ITU-T E.164: none begins another, so the digits alone tell where the code ends.
COUNTRY = "^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
MALE = r"Mr|Herr|Herrn|Monsieur|Señor|Signor|г-н|господин"
FEMALE = r"Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Signora|г-жа|госпожа"
NEUTRAL = "Dr|Prof|Professor|Doktor|Dott|Dra|Ing|Sir|Lady|Lord|Dame|Rev|др|проф"
MALE, FEMALE, NEUTRAL = (f"{titles}|{titles.upper()}" for titles in (MALE, FEMALE, NEUTRAL))
TITLES = f"{MALE}|{FEMALE}|{NEUTRAL}"
#: One to four titles in a row, and each word of a name: not a title itself, with an apostrophe after its first letter or without.
HEAD = rf"(?:(?:{TITLES})\.? ){{1,4}}"
NAME = rf"(?!(?:{TITLES})(?![\p{{L}}\p{{N}}]))\p{{Lu}}(?:['’]\p{{Lu}})?\p{{L}}+"
PERSON = rf"(?<![\p{{L}}\p{{N}}]){HEAD}{NAME}(?:[ \-]{NAME}){{0,2}}"
KINDS = (("email", EMAIL), ("credential", CREDENTIAL), ("iban", IBAN), ("ip", IP), ("ssn", SSN), ("card", CARD), ("phone", PHONE), ("person", PERSON))
ANY = "|".join(f"(?:{p})" for _, p in KINDS)

#: The same, and capitalised words, for texts in which persons are found.
MENTIONS = rf"{ANY}|(?:(?<![\p{{L}}\p{{N}}]){NAME}(?![\p{{L}}\p{{N}}]))"
HONORIFICS = sorted(set(TITLES.split("|")))
#: Without any of these in it, a text has no entity: a digit or @, a hexadecimal key of letters alone, the start of a key, an honorific.
SIGNS = "[0-9@]|[a-f]{32}|[A-F]{32}"
KEYS = ("AKIA", *(f"{p}{c}" for p in ("sk", "pk", "ghp", "gho", "xoxb") for c in "-_"))
STARTS = [*KEYS, *(h for h in HONORIFICS if not any(h != o and h.startswith(o) for o in HONORIFICS))]


def suspect(text: Column) -> Column:
    """A cheap test that most texts fail: only the others are searched with all patterns."""
    found = text.rlike(SIGNS)
    for start in STARTS:
        found = found | text.contains(start)
    return F.coalesce(found, F.lit(False))


# Syllables of surrogate names, by script, and the endings of given names by gender.
LATIN = ("ba", "ce", "di", "fo", "ga", "he", "ji", "ko", "la", "me", "ni", "po", "ra", "se", "ti", "va")
CYRILLIC = ("ба", "ве", "ги", "до", "жа", "зе", "ки", "ло", "ма", "не", "пи", "ро", "са", "те", "фи", "ха")
LATIN_END = {"male": "n", "female": "na"}
CYRILLIC_END = {"male": "н", "female": "на"}


def stream(key: str, kind: Column, atom: Column, attempt: Column) -> Column:
    """256 keyed hexadecimal digits."""
    source = F.concat_ws("|", F.lit(key), kind, atom, attempt.cast("string"))
    return F.concat(F.sha2(source, 512), F.sha2(F.concat(source, F.lit("|+")), 512))


def nibble(hexes: Column, i: Column) -> Column:
    """The i-th (from 0, wrapping) digit of the stream as a number."""
    return F.instr(F.lit("0123456789abcdef"), F.substring(hexes, i % 256 + 1, F.lit(1))) - 1


def pick(choices: str, hexes: Column, i: Column) -> Column:
    """One of at most 256 characters, by two digits of the stream."""
    return F.substring(F.lit(choices), (nibble(hexes, i * 2) * 16 + nibble(hexes, i * 2 + 1)) % len(choices) + 1, F.lit(1))


def each_char(text: Column, f) -> Column:
    return F.array_join(F.transform(F.split(text, ""), lambda c, i: f(c, i + 1)), "")


def letters_and_digits(text: Column, hexes: Column, hexadecimal: bool = False) -> Column:
    """Each digit and letter redrawn in its class and script; all else stays."""
    low, high = ("abcdef", "ABCDEF") if hexadecimal else ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return each_char(
        text,
        lambda c, i: F.when(c.rlike("[0-9]"), pick("0123456789", hexes, i))
        .when(c.rlike(r"\p{IsCyrillic}"), pick("абвгдежзиклмнопрстуфх", hexes, i))
        .when(c.rlike(r"\p{Lu}"), pick(high, hexes, i))
        .when(c.rlike(r"\p{L}"), pick(low, hexes, i))
        .otherwise(c),
    )


def luhn_sum(digits: Column, double_last: bool) -> Column:
    """Luhn sum of a string of digits, the last doubled or not."""
    n = F.length(digits)

    def one(i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        odd = ((n - i) % 2) == (0 if double_last else 1)
        return F.when(odd, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), one), F.lit(0), lambda a, x: a + x)


def kind_of(entity: Column) -> Column:
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(KINDS):
        kind = F.when(entity.rlike(f"^(?:{pattern})$"), name).otherwise(kind)
    return kind


def canonical(kind: Column, entity: Column) -> Column:
    digits = F.regexp_replace(entity, "[^0-9]", "")
    return (
        F.when(kind.isin("card", "ssn", "phone"), digits)
        .when(kind == "iban", F.regexp_replace(entity, " ", ""))
        .otherwise(entity)
    )


def gender(entity: Column) -> Column:
    title = lambda which: entity.rlike(rf"^(?:(?:{TITLES})\.? )*(?:{which})\.? ")
    return F.when(title(FEMALE), "female").when(title(MALE), "male").otherwise("any")


def atoms(entities: DataFrame) -> DataFrame:
    """``(entity, kind, n, atom_kind, atom, shown)``: what each distinct entity is made of.

    A person's last name is an atom of its own, so it stays the same with and
    without a given name; given names are drawn within their gender. So is the host of a mailbox.
    """
    kind = kind_of(F.col("entity"))
    names = F.split(F.regexp_replace("entity", f"^{HEAD}", ""), r"[ \-]")
    part = lambda atom_kind, atom, shown: F.struct(atom_kind.alias("atom_kind"), atom.alias("atom"), shown.alias("shown"))
    of_person = F.transform(
        names, lambda x, i: part(F.when(i == F.size(names) - 1, "surname").otherwise(F.concat(F.lit("given-"), gender(F.col("entity")))), F.lower(x), x)
    )
    at = F.split("entity", "@")
    of_mail = F.array(part(F.lit("mailbox"), F.lower(at[0]), at[0]), part(F.lit("host"), F.lower(at[1]), at[1]))
    # digits behind a + begin with a country code, others don't: a kind each, as the code stays
    other_kind = F.when((F.col("kind") == "phone") & F.col("entity").startswith("+"), "phone+").otherwise(F.col("kind"))
    other = F.array(part(other_kind, canonical(F.col("kind"), F.col("entity")), F.col("entity")))
    return (
        entities.withColumn("kind", kind)
        .select("entity", "kind", F.posexplode(F.when(F.col("kind") == "person", of_person).when(F.col("kind") == "email", of_mail).otherwise(other)).alias("n", "a"))
        .select("entity", "kind", "n", "a.*")
    )


def mod97(text: Column) -> Column:
    """What is left of the number that letters (A = 10) and digits make, divided by 97."""
    return F.aggregate(
        F.split(text, ""), F.lit(0), lambda a, c: F.when(c == "", a).when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    )


def drawn() -> Column:
    """The surrogate of (atom_kind, atom, attempt), canonical, by the keyed digits ``h``."""
    kind, atom, h, attempt = F.col("atom_kind"), F.col("atom"), F.col("h"), F.col("attempt")
    times = lambda n, f: F.array_join(F.transform(F.slice(F.sequence(F.lit(0), n), 2, 1000), f), "")  # f of 1 to n
    octet = lambda i: ((nibble(h, F.lit(2 * i)) * 16 + nibble(h, F.lit(2 * i + 1))) % 254 + 1).cast("string")
    rest = lambda n: F.substring(atom, F.lit(n + 1) if isinstance(n, int) else n + 1, F.length(atom))
    plain = letters_and_digits(atom, h)
    country = F.regexp_extract(atom, COUNTRY, 0)
    body = F.substring(plain, F.lit(1), F.length(atom) - 1)
    check = ((10 - luhn_sum(body, True) % 10) % 10).cast("string")
    card = F.when((luhn_sum(atom, False) % 10 == 0) & (attempt < LONGER), F.concat(body, check)).otherwise(plain)
    # a digit more for every so many draws of a number
    longer = times(F.floor(attempt / LONGER).cast("int"), lambda i: pick("0123456789", h, i + 64))
    account = letters_and_digits(rest(4), h)
    valid = mod97(F.concat(rest(4), F.substring(atom, 1, 4))) == 1
    of_account = F.lpad((98 - mod97(F.concat(account, F.substring(atom, 1, 2), F.lit("00")))).cast("string"), 2, "0")
    iban = F.concat(F.substring(atom, 1, 2), F.when(valid, of_account).otherwise(letters_and_digits(F.substring(atom, 3, 2), h)), account)
    prefix = F.regexp_extract(atom, f"^(?:{PREFIX})", 0)
    secret = letters_and_digits(rest(F.length(prefix)), h)
    credential = F.when(prefix != "", F.concat(prefix, secret)).otherwise(letters_and_digits(atom, h, hexadecimal=True))

    def name(syllables, endings):
        s = F.array(*map(F.lit, syllables))
        stem = F.concat(*[F.element_at(s, nibble(h, F.lit(i)) + 1) for i in range(3)])
        end = F.when(kind == "given-female", endings["female"]).when(kind == "given-male", endings["male"]).otherwise(F.element_at(s, nibble(h, F.lit(3)) + 1))
        return F.concat(stem, times(attempt, lambda i: F.element_at(s, nibble(h, i + 4) + 1)), end)

    latin = F.array(*map(F.lit, LATIN))
    label = F.concat(*[F.element_at(latin, nibble(h, F.lit(200 + i)) + 1) for i in range(5)], times(attempt, lambda i: F.element_at(latin, nibble(h, i + 210) + 1)))
    host = F.concat(label, F.lit(".example."), F.element_at(F.array(F.lit("com"), F.lit("net"), F.lit("org")), nibble(h, F.lit(251)) % 3 + 1))
    person = F.when(atom.rlike(r"\p{IsCyrillic}"), name(CYRILLIC, CYRILLIC_END)).otherwise(name(LATIN, LATIN_END))
    return (
        F.when(kind == "mailbox", F.concat(plain, times(attempt, lambda i: pick("abcdefghijklmnopqrstuvwxyz", h, i + 64))))
        .when(kind == "host", host)
        .when(kind == "ip", F.concat_ws(".", *[octet(i) for i in range(4)]))
        .when(kind == "card", F.concat(card, longer))
        .when(kind == "credential", credential)
        .when((kind == "surname") | kind.startswith("given-"), person)
        .when(kind == "iban", iban)
        .when(kind == "phone+", F.concat(country, letters_and_digits(rest(F.length(country)), h), longer))
        .otherwise(F.concat(plain, longer))
    )


def draw(atoms_: DataFrame, key: str) -> DataFrame:
    """Add ``surrogate``; its digits are a column of their own, so each is hashed once."""
    h = stream(key, F.col("atom_kind"), F.col("atom"), F.col("attempt"))
    return atoms_.withColumn("h", h).withColumn("surrogate", drawn()).drop("h")


#: A number's surrogate gets a digit more after so many draws that collide.
LONGER = 16
#: Draws before it is an error; only IPv4 addresses, IBANs and keys can't get longer.
MOST_DRAWS = 200


def surrogates(found: DataFrame, key: str) -> DataFrame:
    """``(atom_kind, atom, surrogate)``: one row an atom, no surrogate twice in a kind, none an atom that occurs.

    Colliding atoms draw again until none collides. A round settles the share of them for which their
    format still has room, so rounds are few; only a format that can't grow and is all in use raises an error.
    """
    all_atoms = cut(found.select("atom_kind", "atom").distinct())
    taken = all_atoms.select("atom_kind", F.col("atom").alias("surrogate"), F.lit(-1).alias("attempt"))
    done = cut(draw(all_atoms.withColumn("attempt", F.lit(0)), key))
    first = W.partitionBy("atom_kind", "surrogate").orderBy("attempt", "atom")
    for attempt in range(1, MOST_DRAWS):
        marked = done.unionByName(taken, allowMissingColumns=True).withColumn("rank", F.row_number().over(first)).where("atom is not null")
        again = marked.where("rank > 1").select("atom_kind", "atom", F.lit(attempt).alias("attempt"))
        if again.isEmpty():
            return done.select("atom_kind", "atom", "surrogate")
        done = cut(marked.where("rank = 1").select("atom_kind", "atom", "attempt", "surrogate").unionByName(draw(again, key)))
    raise RuntimeError("a format has no distinct surrogates left: " + ", ".join(r.atom_kind for r in again.select("atom_kind").distinct().collect()))


def laid_out(kind: Column, shown: Column, surrogate: Column) -> Column:
    """The canonical surrogate in the format of what is shown."""
    digits_before = lambda i: F.length(F.regexp_replace(F.substring(shown, F.lit(1), i), "[^0-9]", ""))
    more = F.substring(surrogate, digits_before(F.length(shown)) + 1, F.length(surrogate))  # where the number had to get longer
    as_digits = F.concat(each_char(shown, lambda c, i: F.when(c.rlike("[0-9]"), F.substring(surrogate, digits_before(i), F.lit(1))).otherwise(c)), more)
    solid_before = lambda i: F.length(F.regexp_replace(F.substring(shown, F.lit(1), i), " ", ""))
    spaced = each_char(shown, lambda c, i: F.when(c == " ", c).otherwise(F.substring(surrogate, solid_before(i), F.lit(1))))
    as_name = F.when(shown.rlike(r"^[\p{Lu}'’]{2,}$"), F.upper(surrogate)).otherwise(F.initcap(surrogate))
    as_box = each_char(surrogate, lambda c, i: F.when(F.substring(shown, i, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c))
    as_host = F.when(shown.rlike(r"\p{Lu}") & ~shown.rlike(r"\p{Ll}"), F.upper(surrogate)).otherwise(surrogate)
    return (
        F.when(kind.isin("card", "ssn", "phone", "phone+"), as_digits)
        .when(kind == "iban", spaced)
        .when((kind == "surname") | kind.startswith("given-"), as_name)
        .when((kind == "mailbox") & shown.rlike(r"\p{Lu}"), as_box)
        .when(kind == "host", as_host)
        .otherwise(surrogate)
    )


def replaced_parts(occurrences: DataFrame, key: str) -> DataFrame:
    """``(entity, kind, n, atom_kind, original, shown)``: what the distinct entities of ``occurrences`` are made of, and what stands for each part."""
    made_of = cut(atoms(occurrences.select("entity").distinct()))
    of_atom = surrogates(made_of, key)
    shown = laid_out(F.col("atom_kind"), F.col("shown"), F.col("surrogate"))
    return made_of.join(of_atom, ["atom_kind", "atom"]).select("entity", "kind", "n", "atom_kind", F.col("shown").alias("original"), shown.alias("shown"))


def replacements(occurrences: DataFrame, key: str) -> DataFrame:
    """``(entity, replacement)`` of the distinct entities of ``occurrences``."""
    return put_together(replaced_parts(occurrences, key))


def put_together(parts: DataFrame) -> DataFrame:
    """``(entity, replacement)`` of the parts of entities."""
    whole = parts.groupBy("entity", "kind").agg(F.sort_array(F.collect_list(F.struct("n", "shown"))).alias("p"))
    shown = F.transform("p", lambda x: x["shown"])
    # a person: titles, then the names with the separators of the original
    seps = F.split(F.regexp_replace(F.regexp_replace("entity", f"^{HEAD}", ""), r"[^ \-]+", "\u0001"), "\u0001")
    names = F.array_join(F.transform(shown, lambda x, i: F.concat(x, F.coalesce(F.get(seps, i + 1), F.lit("")))), "")
    person = F.concat(F.regexp_extract("entity", f"^{HEAD}", 0), names)
    return whole.select("entity", F.when(F.col("kind") == "person", person).otherwise(F.array_join(shown, "@")).alias("replacement"))


def key_of(spark: SparkSession) -> str:
    """The key of the session's configuration; where there is none, a random one is put there."""
    key = spark.conf.get(KEY, None)
    if key is None:
        spark.conf.set(KEY, key := secrets.token_hex(32))
    return key


def with_surrogates(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``docs`` with every detected entity in ``text`` replaced, and ``n_entities`` behind its columns.

    The same ``key`` gives the same surrogates; by default it is the session's (``KEY``).

    * a null text stays null, an empty one empty; ``n_entities`` is then 0;
    * a person is found by a title; later and earlier mentions of the surname alone, or of given names before it, in the
      same text are replaced alike and counted; after a title that tells no gender, given names are drawn from names of any;
    * texts are scanned and rewritten whole, at any length, and all between entities stays byte for byte;
    * repeated rows each come back, rewritten alike; a null ``doc_id`` is allowed;
    * an empty table gives an empty result; a column of ``docs`` named ``n_entities`` is replaced,
      any other name is kept as it is.

    Rows that can't hold an entity go straight through; only the others take part in
    the exchange that brings surrogates back by text. A popular entity is one row of
    the mapping, and its occurrences are joined once for each text.
    """
    key = key or key_of(docs.sparkSession)
    own = [c for c in docs.columns if c != "n_entities"]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col("text"), F.md5(F.col("text").cast("binary")).alias("row_id"))
    may = keyed.where(suspect(F.col("text")))
    hits = may.select("row_id", F.regexp_extract_all("text", F.lit(ANY), F.lit(0)).alias("hits"))
    hits = cut(hits.where(F.size("hits") > 0).dropDuplicates(["row_id"]))
    occurrences = hits.select("row_id", F.posexplode("hits").alias("n", "entity"))
    parts = cut(replaced_parts(occurrences, key))
    whole = put_together(parts)
    # the names of the persons that are found in a text: their other mentions in it follow them
    of_person = parts.where("kind = 'person'").select("entity", F.col("original").alias("word"), F.struct((F.col("atom_kind") == "surname").alias("surname"), F.col("shown").alias("new")).alias("x"))
    known = cut(occurrences.join(of_person, "entity").groupBy("row_id", "word").agg(F.max("x").alias("x")).select("row_id", "word", "x.surname", "x.new"))
    named = known.select("row_id").distinct()
    words = may.join(named, "row_id", "left_semi").dropDuplicates(["row_id"]).select("row_id", F.posexplode(F.regexp_extract_all("text", F.lit(MENTIONS), F.lit(0))).alias("n", "entity"))
    words = words.join(whole, "entity", "left").join(known.withColumnRenamed("word", "entity"), ["row_id", "entity"], "left")
    # a given name is one where the next capitalised word is one of the names, too
    followed = F.lead(F.col("new").isNotNull(), 1, False).over(W.partitionBy("row_id").orderBy("n"))
    new = F.coalesce("replacement", F.when(F.col("surname") | followed, F.col("new")))
    words = words.withColumn("found", new).select("row_id", "n", F.coalesce("found", "entity").alias("replacement"), F.col("found").isNotNull().cast("long").alias("hit"), F.lit(True).alias("named"))
    others = occurrences.join(named, "row_id", "left_anti").join(whole, "entity").select("row_id", "n", "replacement", F.lit(1).cast("long"), F.lit(False))
    by_row = words.union(others).groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("n", "replacement"))).alias("new"), F.sum("hit").alias("hit"), F.max("named").alias("named"))
    between = F.when(F.col("named"), F.split("text", MENTIONS, -1)).otherwise(F.split("text", ANY, -1))
    # zipped, so that the text is split once, however many entities it has
    pairs = F.zip_with("new", between, lambda x, rest: F.concat(rest, F.coalesce(x["replacement"], F.lit(""))))
    text = F.array_join(pairs, "")
    changed = F.col("new").isNotNull()
    out = (
        may.join(by_row, "row_id", "left")
        .withColumn("n_entities", F.when(changed, F.col("hit")).otherwise(0).cast("long"))
        .withColumn("text", F.when(changed, text).otherwise(F.col("text")))
    )
    value = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    kept = [F.when(changed, value[c]).otherwise(F.col(f"row.`{c}`")).alias(c) if c in value else F.col(f"row.`{c}`").alias(c) for c in own]
    through = keyed.where(~suspect(F.col("text"))).select(*[F.col(f"row.`{c}`").alias(c) for c in own], F.lit(0).cast("long").alias("n_entities"))
    return through.union(out.select(*kept, "n_entities"))


def op4_pii_surrogates(spark, sf_dir):
    from walkframe.llm.common import table

    return with_surrogates(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities")


QUERIES = {"op4_pii_surrogates": op4_pii_surrogates}
ORACLE_SQL: dict[str, str] = {}
