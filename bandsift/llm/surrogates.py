"""PII surrogates: keyed, type-consistent replacements, distinct and the same throughout the corpus.

Entities are found by one pattern; each has a kind and a canonical form (a number without separators,
an address in lower case), which is what coreference goes by. The replacement is drawn from a hash of
a secret key, kind and canonical form, character by character within its class: digit for digit, hex
digit for hex digit, vowel for vowel and consonant for consonant of the same script, and laid out like
the mention it replaces (separators, capitals). Country and issuer digits, top-level domains, labels
and titles stay, as does a name's last letter, so that its gender still agrees with the title; check
digits of cards and IBANs are computed anew. Each word of a name is an entity of its own (a hyphened or
apostrophed one is a word), so a family name is replaced alike with and without the given name.

A draw may meet another draw or an entity that is really in the corpus. All distinct entities are
checked; only those that lost draw again, and only they are joined back to texts. Some have too little
room for that (a two-letter name keeps its last letter), so later draws get longer, one character more
each time, until all are apart. Everything is column functions and joins.

Edge cases: what follows a label without any letter or digit is a mask and no entity; a null text stays
null, an empty one empty, both without entities; repeated rows get the same replacements; other columns
are kept; an empty table gives no rows. Two spellings of one IPv6 address are two entities.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandsift.llm.common import cut_lineage, free

TITLES = "Mrs|Mr|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Señora|Señor|Господин|Госпожа"

#: A word of a name; the second word after a title is a mention of its own.
NAME = r"\p{Lu}[\p{L}'’-]*\p{L}"

#: kind -> pattern, in the order in which they are tried.
PATTERNS = {
    "secret": r"(?i:(?<![A-Za-z0-9])(?:token|secret|password|passwd|api_?key)\s{0,3}[=:]\s{0,3}[\"']?)(?=[^\s\"']*[\p{L}\p{N}])[^\s\"']{8,}+",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "hex_key": r"(?<![0-9A-Za-z])[0-9a-f]{32,}+(?![0-9A-Za-z])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "ipv6": r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]{0,39}::)(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])",
    "phone": r"(?<![0-9])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])"
    r"|(?<![0-9])00(?=[1-9](?:[ .()-]{0,2}[0-9]){8,13}(?![0-9]))[1-9][0-9]{0,2}[ .-]\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,8}){1,4}(?![0-9])|(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "person": rf"\b(?:{TITLES})\.? {NAME}|(?<= )(?=\p{{Lu}})(?<=\b(?:{TITLES})\.? \p{{Lu}}[\p{{L}}'’-]{{1,40}} ){NAME}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
LABEL = r"^(?i:(?:token|secret|password|passwd|api_?key)\s{0,3}[=:]\s{0,3}[\"']?)"
TITLE = rf"^(?:{TITLES})\.? "

#: A text without any of these has no entity.
HINT = rf"[0-9@]|::|(?i:token|secret|password|passwd|api_?key)|\b(?:{TITLES})\b"

#: Letters that stand for one another.
CLASSES = ["aeiou", "bcdfghjklmnpqrstvwxyz", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "0123456789"]

#: Letters and digits that CLASSES lacks, by script: any of one script becomes one of these.
SCRIPTS = {
    r"\p{IsLatin}": "abcdefghijklmnopqrstuvwxyz",
    r"\p{IsCyrillic}": "абвгдежзиклмнопрстуфхцчшэюя",
    r"\p{IsGreek}": "αβγδεζηθικλμνξοπρστυφχψω",
    r"\p{IsArmenian}": "".join(map(chr, range(0x561, 0x586))),
    r"[\p{IsHan}&&\p{L}]": "".join(map(chr, range(0x4E00, 0x4F00))),
    r"[\u0660-\u0669]": "".join(map(chr, range(0x660, 0x66A))),
    r"[\u06F0-\u06F9]": "".join(map(chr, range(0x6F0, 0x6FA))),
    r"[\u0966-\u096F]": "".join(map(chr, range(0x966, 0x970))),
    r"[\p{IsArabic}&&\p{L}]": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    r"[\p{IsHebrew}&&\p{L}]": "אבגדהוזחטיכלמנסעפצקרשת",
    r"[\p{IsHangul}&&\p{L}]": "".join(map(chr, range(0xAC00, 0xAC00 + 28 * 256, 28))),
    r"[\p{IsHiragana}&&\p{L}]": "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ",
    r"[\p{IsKatakana}&&\p{L}]": "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワ",
    r"[\p{IsBopomofo}&&\p{L}]": "".join(map(chr, range(0x3105, 0x3126))),
    r"[\p{IsThai}&&\p{L}]": "".join(map(chr, range(0xE01, 0xE2F))),
    r"[\p{IsLao}&&\p{L}]": "ກຂຄງຈຊຍດຕຖທນບປຜຝພຟມຢຣລວສຫອຮ",
    r"[\p{IsDevanagari}&&\p{L}]": "".join(map(chr, range(0x915, 0x929))),
    r"[\p{IsBengali}&&\p{L}]": "".join(map(chr, range(0x995, 0x9A9))),
    r"[\p{IsGurmukhi}&&\p{L}]": "".join(map(chr, range(0xA15, 0xA29))),
    r"[\p{IsGujarati}&&\p{L}]": "".join(map(chr, range(0xA95, 0xAA9))),
    r"[\p{IsTamil}&&\p{L}]": "கஙசஞடணதநபமயரலவ",
    r"[\p{IsTelugu}&&\p{L}]": "".join(map(chr, range(0xC15, 0xC29))),
    r"[\p{IsKannada}&&\p{L}]": "".join(map(chr, range(0xC95, 0xCA9))),
    r"[\p{IsMalayalam}&&\p{L}]": "".join(map(chr, range(0xD15, 0xD29))),
    r"[\p{IsSinhala}&&\p{L}]": "".join(map(chr, range(0xD9A, 0xDB2))),
    r"[\p{IsGeorgian}&&\p{L}]": "".join(map(chr, range(0x10D0, 0x10F1))),
    r"[\p{IsEthiopic}&&\p{L}]": "".join(map(chr, range(0x1208, 0x1248))),
    r"[\p{IsKhmer}&&\p{L}]": "".join(map(chr, range(0x1780, 0x17A3))),
    r"[\p{IsMyanmar}&&\p{L}]": "".join(map(chr, range(0x1000, 0x1021))),
    r"\p{L}": "abcdefghijklmnopqrstuvwxyz",
    r"\p{N}": "0123456789",
}

#: Draws of an entity that are as long as itself. Each later one is a character longer than the last.
PLAIN_DRAWS = 6


def entities(text: Column) -> Column:
    """All mentions in the order of the text."""
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    return F.when(text.rlike(HINT), found).otherwise(F.array().cast("array<string>"))


def bare(mention: Column) -> Column:
    """The mention without the label that gave a secret away."""
    return F.regexp_replace(mention, LABEL, "")


def kind_of(mention: Column) -> Column:
    """A secret that looks like another kind has that kind, as it may be mentioned without its label."""
    out = F.when(mention.rlike(LABEL), "secret").otherwise("person")
    for kind, pattern in reversed(list(PATTERNS.items())[1:-1]):
        out = F.when(bare(mention).rlike(rf"\A(?:{pattern})\z"), kind).otherwise(out)
    return out


def canonical(kind: Column, mention: Column) -> Column:
    own = bare(mention)
    return (
        F.when(kind.isin("phone", "card", "national_id"), F.regexp_replace(own, "[^0-9]", ""))
        .when(kind.isin("email", "ipv6"), F.lower(own))
        .when(kind == "iban", F.regexp_replace(own, " ", ""))
        .when(kind == "person", F.lower(F.regexp_replace(mention, TITLE, "")))
        .otherwise(own)
    )


def _stays(kind: Column) -> Column:
    """Leading characters that a replacement keeps."""
    return F.when(kind.isin("phone", "card"), 1).when(kind == "iban", 2).when(kind == "access_key", 4).otherwise(0)


def _more(x: Column, names: list[str], **new: Column) -> Column:
    return F.struct(*(x[n].alias(n) for n in names), *(v.alias(n) for n, v in new.items()))


def draws(items: Column, key: str) -> Column:
    """Array of (kind, form, attempt): adds `drawn`, the replacement in canonical form.

    Steps follow one another over the array, so that nothing is computed twice.
    """
    names = ["kind", "form", "attempt"]

    def longer(x: Column) -> Column:
        """`long`: the form with what later draws add, before it is swapped."""
        kind, form, more = x["kind"], x["form"], x["attempt"] - PLAIN_DRAWS + 1
        own = F.when(kind.isin("person", "email", "secret"), F.regexp_extract(form, r"[\p{L}\p{N}]", 0)).otherwise("0")
        wide = F.concat(F.substring(form, F.lit(1), _stays(kind)), F.repeat(own, more), F.substring(form, _stays(kind) + 1, F.length(form)))
        return _more(x, names, long=F.when(more > 0, wide).otherwise(form))

    def seed(x: Column) -> Column:
        one = F.concat_ws("|", F.lit(key), x["kind"], x["attempt"].cast("string"), x["form"])
        return _more(x, [*names, "long"], seed=F.sha2(one, 256), bare=F.translate(x["long"], "áàâäãåéèêëíìîïóòôöõúùûüýñçß", "aaaaaaeeeeiiiiooooouuuuyncs"))

    def stream(x: Column) -> Column:
        """Blocks of 32 bytes in hex, enough for a byte (an octet) of each character."""
        blocks = F.floor(F.greatest(F.length(x["bare"]), x["attempt"] + 4) / 32).cast("int")
        return _more(x, [*names, "long", "bare"], stream=F.transform(F.sequence(F.lit(0), blocks), lambda i: F.sha2(F.concat(x["seed"], i.cast("string")), 256)))

    def swapped(x: Column) -> Column:
        kind, form, n, before = x["kind"], x["long"], F.length(x["long"]), _stays(x["kind"])
        dot = n - F.length(F.substring_index(form, ".", -1))
        after = F.when(kind == "email", dot).when(kind == "person", n - 1).otherwise(n)

        def block(i: Column, held: int) -> Column:
            return F.element_at(x["stream"], F.floor(i / held).cast("int") + 1)

        def byte(i: Column) -> Column:
            return F.conv(F.substring(block(i, 32), F.pmod(i, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")

        def swap(c: Column, i: Column) -> Column:
            def picked(own: str) -> Column:
                return F.substring(F.lit(own), F.pmod(byte(i), F.lit(len(own))) + 1, F.lit(1))

            out = c
            for pattern, letters in reversed(SCRIPTS.items()):
                cased = picked(letters) if letters.upper() == letters else F.when(c.rlike(r"\p{Lu}"), picked(letters.upper())).otherwise(picked(letters))
                out = F.when(c.rlike(pattern), cased).otherwise(out)
            out = F.when(c.rlike(r"[\p{L}\p{N}]"), out).otherwise(c)
            for letters in CLASSES:
                for own in dict.fromkeys((letters, letters.upper())):
                    out = F.when(F.instr(F.lit(own), c) > 0, picked(own)).otherwise(out)
            hexed = F.when(F.instr(F.lit("0123456789abcdef"), c) > 0, F.substring(block(i, 64), F.pmod(i, F.lit(64)) + 1, F.lit(1))).otherwise(c)
            return F.when((i < before) | (i >= after), F.substring(form, i + 1, F.lit(1))).when(kind.isin("hex_key", "ipv6"), hexed).otherwise(out)

        last = F.greatest(x["attempt"] - PLAIN_DRAWS + 1, F.lit(0)) + 3
        octets = F.array_join(F.transform(F.sequence(F.lit(0), last), lambda i: (F.pmod(byte(i), F.lit(223)) + 1).cast("string")), ".")
        letters = F.array_join(F.transform(F.slice(F.split(x["bare"], "", -1), 1, n), swap), "")
        return _more(x, names, plain=F.when(kind == "ip", octets).otherwise(letters))

    def checked(x: Column) -> Column:
        right = F.when(x["kind"] == "card", _with_check_digit(x["plain"])).when(x["kind"] == "iban", _with_check_number(x["plain"]))
        return _more(x, names, drawn=right.otherwise(x["plain"]))

    for step in (longer, seed, stream, swapped, checked):
        items = F.transform(items, step)
    return items


def _with_check_digit(digits: Column) -> Column:
    """The number with its last digit replaced so that the mod-10 check holds."""
    n = F.length(digits)
    body = F.transform(F.slice(F.split(digits, "", -1), 1, F.greatest(n - 1, F.lit(0))), lambda c: c.cast("int"))

    def weigh(d: Column, i: Column) -> Column:
        twice = F.pmod(n - i, F.lit(2)) == 0
        return F.when(twice, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    total = F.aggregate(F.transform(body, weigh), F.lit(0), lambda a, d: a + d)
    return F.concat(F.array_join(F.transform(body, lambda d: d.cast("string")), ""), F.pmod(-total, F.lit(10)).cast("string"))


def _with_check_number(iban: Column) -> Column:
    """The account number with its third and fourth characters replaced so that the mod-97 check holds."""
    country, account = F.substring(iban, 1, 2), F.substring(iban, F.lit(5), F.length(iban))
    moved = F.split(F.concat(account, country, F.lit("00")), "", -1)

    def step(rest: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c == "", rest).when(c.rlike("[0-9]"), F.pmod(rest * 10 + F.ascii(c) - 48, F.lit(97))).otherwise(F.pmod(rest * 100 + letter, F.lit(97)))

    return F.concat(country, F.lpad((F.lit(98) - F.aggregate(moved, F.lit(0), step)).cast("string"), 2, "0"), account)


def laid_out(kind: Column, mention: Column, form: Column) -> Column:
    """The canonical replacement with the separators and capitals of the mention; what it has more stands last."""
    head = F.when(kind == "person", F.regexp_extract(mention, TITLE, 0)).otherwise(F.regexp_extract(mention, LABEL, 0))
    rest = F.substring(mention, F.length(head) + 1, F.length(mention))
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    digit_kind = kind.isin("phone", "card", "national_id")

    def cased(c: Column, own: Column) -> Column:
        return F.when(c.rlike(r"\p{Lu}"), F.upper(own)).otherwise(own)

    def step(a: Column, c: Column) -> Column:
        skip = (digit_kind & ~c.rlike("[0-9]")) | ((kind == "iban") & (c == " "))
        own = F.substring(form, a["at"], F.lit(1))
        return F.struct(F.concat(a["out"], F.when(skip, c).otherwise(cased(c, own))).alias("out"), (a["at"] + F.when(skip, 0).otherwise(1)).alias("at"))

    def whole(a: Column) -> Column:
        return F.concat(a["out"], F.substring(form, a["at"], F.length(form)))

    letters = F.slice(F.split(rest, "", -1), 1, F.length(rest))
    # Separators occur in kinds of bounded length only; the others, of any length, go letter by letter.
    spaced = F.aggregate(letters, start, step, whole)
    plain = F.array_join(F.zip_with(letters, F.slice(F.split(form, "", -1), 1, F.length(form)), cased), "")
    shaped = F.when(digit_kind | (kind == "iban"), spaced).otherwise(plain)
    return F.concat(head, F.when(kind == "ip", form).otherwise(shaped))


def redraws(found: DataFrame, key: str) -> DataFrame:
    """(kind, form, attempt) of the entities (kind, form), each once, whose first draw clashed.

    A clash is a draw equal to a real entity or to another's draw, of any kind, since kinds may look
    alike; of several that draw the same, the smallest kind and form keeps it. Later draws are checked
    against all earlier ones too.
    """
    real = cut_lineage(found)
    pending = real
    taken: DataFrame | None = None
    lost: DataFrame | None = None
    for attempt in count():
        one = F.array(F.struct("kind", "form", F.lit(attempt).alias("attempt")))
        drawn = cut_lineage(pending.select("kind", "form", F.element_at(draws(one, key), 1)["drawn"].alias("drawn")))
        first = drawn.groupBy("drawn").agg(F.min(F.struct("kind", "form")).alias("first")).select("drawn", "first.*")
        clean = first.join(real.select(F.col("form").alias("drawn")), "drawn", "left_anti")
        if taken is not None:
            clean = clean.join(taken, "drawn", "left_anti")
        kept = cut_lineage(clean.select("kind", "form", "drawn"))
        pending = cut_lineage(drawn.select("kind", "form").join(kept.select("kind", "form"), ["kind", "form"], "left_anti"))
        if attempt:
            again = kept.select("kind", "form", F.lit(attempt).alias("attempt"))
            lost = again if lost is None else lost.unionByName(again)
        if pending.isEmpty():
            break
        taken = kept.select("drawn") if taken is None else taken.unionByName(kept.select("drawn"))
    return real.select("kind", "form", F.lit(0).alias("attempt")).limit(0) if lost is None else lost


def _with_attempts(own: DataFrame, again: DataFrame, found: str, names: tuple[str, str, str]) -> DataFrame:
    """Adds a map from the place of each redrawn mention to its attempt; null where a text has none."""
    id_, hash_, again_at = names
    places = own.filter(F.size(found) > 0).select(F.col("doc_id").alias(id_), F.xxhash64("text").alias(hash_), F.posexplode(found).alias("at", "mention"))
    places = places.withColumn("kind", kind_of(F.col("mention"))).withColumn("form", canonical(F.col("kind"), F.col("mention")))
    redrawn = places.join(again, ["kind", "form"]).select(id_, hash_, "at", "attempt").distinct()
    # Written, so that its size is known before texts move for it.
    redrawn = cut_lineage(redrawn.groupBy(id_, hash_).agg(F.map_from_entries(F.collect_list(F.struct("at", "attempt"))).alias(again_at)))
    return own.join(redrawn, own["doc_id"].eqNullSafe(redrawn[id_]) & (F.xxhash64(own["text"]) == redrawn[hash_]), "left")


def with_surrogates(docs: DataFrame, key: str, count: str | None = None) -> DataFrame:
    """The documents with every mention replaced; with `count`, a column of that name counts mentions.

    Runs jobs when called: distinct entities are collected in a table and checked.
    """
    text = F.col("text").cast("string")
    mention = docs.filter(text.rlike(HINT)).select(F.explode(entities(text)).alias("mention"))
    kinds = mention.distinct().select(kind_of(F.col("mention")).alias("kind"), "mention")
    found = kinds.select("kind", canonical(F.col("kind"), F.col("mention")).alias("form")).distinct()
    again = cut_lineage(redraws(found, key))

    id_, hash_, again_at, found_, new_ = (free(c, docs.columns) for c in ("_id", "_hash", "_again", "_found", "_new"))
    own = docs.withColumn("text", text).withColumn(found_, entities(F.col("text")))
    # Only texts that hold a redrawn entity; usually there is none, and no text has to move.
    if again.isEmpty():
        joined = own.withColumn(again_at, F.lit(None).cast("map<int,int>"))
    else:
        joined = _with_attempts(own, again, found_, (id_, hash_, again_at))

    named = F.transform(found_, lambda m: F.struct(m.alias("mention"), kind_of(m).alias("kind")))
    items = F.transform(
        named,
        lambda x, i: F.struct(
            x["kind"].alias("kind"), canonical(x["kind"], x["mention"]).alias("form"), F.coalesce(F.element_at(F.col(again_at), i), F.lit(0)).alias("attempt")
        ),
    )
    drawn = joined.withColumn(new_, draws(items, key))
    laid = F.zip_with(found_, new_, lambda m, x: laid_out(x["kind"], m, x["drawn"]))
    between = F.split("text", ANY, -1)
    tails = F.zip_with(laid, F.slice(between, 2, F.size(between)), lambda r, b: F.concat(r, F.coalesce(b, F.lit(""))))
    new = F.when(F.size(found_) > 0, F.concat(F.element_at(between, 1), F.array_join(tails, ""))).otherwise(F.col("text"))
    out = [new.alias("text") if c == "text" else F.col(c) for c in docs.columns]
    if count is not None:
        out.append(F.coalesce(F.size(found_), F.lit(0)).cast("long").alias(count))
    return drawn.select(*out)
