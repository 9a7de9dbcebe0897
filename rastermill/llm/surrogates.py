"""Personal data replaced by keyed surrogates of the same type and form.

One pattern finds e-mail addresses, bank account numbers, access keys, IP addresses, card,
security and telephone numbers and names of people. Every distinct entity gets a surrogate drawn
from a keyed hash: the same entity always the same one (also in other spellings: spaces, hyphens
or capitals), two entities never the same one, and none that stands for somebody in the corpus.
Account and card numbers keep valid check digits, names keep gender and script, everything keeps
length and punctuation where its type allows.

All of it is DataFrame expressions. Texts without entities are never shuffled; of the others
only the entities are, and the surrogates come back by a join on the entity that Spark may split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastermill.llm.common import saved, text_of

# Given names by script and gender, which detection knows and surrogates draw from.
GIVEN = {
    ("latin", "male"): "James John Robert Michael William David Thomas Daniel Paul Peter Hans Karl Jean Pierre Louis Carlos Juan Luis Pedro Miguel".split(),
    ("latin", "female"): "Mary Patricia Linda Barbara Elizabeth Susan Sarah Karen Anna Emma Julia Laura Marie Sophie Claire Carmen Lucia Elena Rosa Isabel".split(),
    ("cyrillic", "male"): "Иван Пётр Сергей Дмитрий Андрей Николай Михаил Павел Борис Олег".split(),
    ("cyrillic", "female"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Вера Нина".split(),
    ("greek", "male"): "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Πέτρος".split(),
    ("greek", "female"): "Μαρία Ελένη Σοφία Άννα Κατερίνα Δήμητρα".split(),
}
# Titles that tell a gender.
TITLES = {
    "male": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин"],
    "female": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа"],
    "any": ["Dr", "Prof"],
}
# Syllables that surnames, and further given names, are made of.
SYLLABLES = {
    "latin": "bal cor den fal gar hol kin lan mar nor pel ran sol tam ven wil bro cal dun fer gil hal jor kel lor mon".split(),
    "cyrillic": "бал вер гор дан зор кал лин мар нов пел рад сол тим фед хар чер шев яр бор кир".split(),
    "greek": "βαλ γορ δαν ζορ καλ λιν μαρ νερ πελ ραν σολ τιμ φαλ χαρ".split(),
}
# How a made-up given name ends.
ENDINGS = {"latin": ("o", "a"), "cyrillic": ("ий", "а"), "greek": ("ος", "α")}

_NAME = r"\p{Lu}(?:\p{L}{0,40}\p{Ll}|\p{Lu}{1,40})(?:[-'’]\p{Lu}\p{L}{1,40})?"
_TITLE = rf"(?:{'|'.join(t for ts in TITLES.values() for t in ts)})"
_KNOWN = rf"(?:{'|'.join(n for ns in GIVEN.values() for n in ns)})"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"

#: Type -> pattern, in order of precedence. Each starts at a boundary, so that no text is scanned twice.
PATTERNS = {
    # No repeated group: the engine recurses on those. A run before the sign is tried once, from its start; at most 253 characters stand after it.
    "email": r"(?<![\w.%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9][A-Za-z0-9.-]{1,252}(?<=[A-Za-z0-9-]\.[A-Za-z]{2,24})(?![A-Za-z])",
    "key": r"(?<![\w-])(?:AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})(?![\w-])",
    "iban": r"(?<![\w])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w])",
    "ip": rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\w]|\.\d)",
    "card": r"(?<![\w-])[3-6](?:[ -]?\d){12,18}(?![\w]|-\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w]|-\d)",
    "phone": r"(?<![\w+(])(?:\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\w]|-\d)",
    "person": rf"(?<![\p{{L}}\d])(?:{_TITLE}\.? (?:{_NAME} )?{_NAME}|{_KNOWN} {_NAME})(?![\p{{L}}\d])",
}
ANY = "|".join(PATTERNS.values())


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def script(column: str) -> str:
    return f"CASE WHEN {column} RLIKE {_quoted(chr(92) + 'p{IsCyrillic}')} THEN 'cyrillic' WHEN {column} RLIKE {_quoted(chr(92) + 'p{IsGreek}')} THEN 'greek' ELSE 'latin' END"


def gender(title: str, name: str) -> str:
    """By the title, else by a known given name."""
    cases = [f"WHEN {title} IN ({', '.join(map(_quoted, TITLES[g]))}) THEN '{g}'" for g in ("male", "female")]
    cases += [f"WHEN {name} IN ({', '.join(_quoted(n) for (_, h), ns in GIVEN.items() if h == g for n in ns)}) THEN '{g}'" for g in ("male", "female")]
    return f"CASE {' '.join(cases)} ELSE 'any' END"


def entities(hits: DataFrame) -> DataFrame:
    """row, pos, part, type, raw, canon: the atoms of every entity found, in order.

    A person is up to three atoms (title, given name, surname), everything else is one. canon is
    what two spellings of one entity have in common.
    """
    found = hits.select("row", F.posexplode("found").alias("pos", "raw"))
    kind = F.coalesce(*(F.when(F.col("raw").rlike(f"^(?:{p})$"), F.lit(t)) for t, p in PATTERNS.items()), F.lit("person"))
    found = found.withColumn("type", kind)
    plain = found.where("type <> 'person'").select("row", "pos", F.lit(0).alias("part"), "type", "raw")
    plain = plain.withColumn(
        "canon",
        F.when(F.col("type").isin("card", "ssn", "phone"), F.regexp_replace("raw", r"[^0-9]", ""))
        .when(F.col("type") == "email", F.lower("raw"))
        .when(F.col("type") == "iban", F.regexp_replace("raw", " ", ""))
        .otherwise(F.col("raw")),
    )
    names = found.where("type = 'person'").select("row", "pos", F.regexp_extract("raw", rf"^({_TITLE})\.? ", 1).alias("t"), F.regexp_extract("raw", rf"^((?:{_TITLE}\.? )?)(.*)$", 1).alias("lead"), "raw")
    names = names.withColumn("words", F.split(F.expr("substring(raw, length(lead) + 1)"), " "))
    names = names.withColumn("given", F.expr("CASE WHEN size(words) > 1 THEN words[0] END")).withColumn("surname", F.expr("element_at(words, -1)"))
    atoms = names.select(
        "row",
        "pos",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("part"), F.lit("kept").alias("type"), F.col("lead").alias("raw")),
                F.struct(F.lit(1).alias("part"), F.expr(f"concat('given:', {script('given')}, ':', {gender('t', 'given')})").alias("type"), F.col("given").alias("raw")),
                F.struct(F.lit(2).alias("part"), F.when(F.col("given").isNotNull(), F.lit("kept")).alias("type"), F.lit(" ").alias("raw")),
                F.struct(F.lit(3).alias("part"), F.expr(f"concat('surname:', {script('surname')})").alias("type"), F.col("surname").alias("raw")),
            )
        ).alias("a"),
    ).select("row", "pos", "a.*")
    atoms = atoms.where("raw IS NOT NULL AND type IS NOT NULL").withColumn("canon", F.lower("raw"))
    return plain.unionByName(atoms)


def _value(hex_: str, i: str) -> str:
    """A number below 4096 for position i (from 1) of the hash."""
    return f"CAST(conv(substring({hex_}, (({i} - 1) % 120) * 3 + 1, 3), 16, 10) AS INT)"


def _shaped(text: str, hex_: str) -> str:
    """Digits by digits, letters by letters of the same case, the rest as it is."""
    v = _value(hex_, "i")
    return f"""array_join(transform(sequence(1, greatest(1, length({text}))), i -> CASE
      WHEN substring({text}, i, 1) RLIKE '[0-9]' THEN CAST({v} % 10 AS STRING)
      WHEN substring({text}, i, 1) RLIKE '[a-z]' THEN substring('abcdefghijklmnopqrstuvwxyz', {v} % 26 + 1, 1)
      WHEN substring({text}, i, 1) RLIKE '[A-Z]' THEN substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ', {v} % 26 + 1, 1)
      ELSE substring({text}, i, 1) END), '')"""


def _luhn(digits: str) -> str:
    """The check digit that completes the digits."""
    return f"""CAST((10 - aggregate(sequence(1, length({digits})), 0, (s, i) -> s + CASE
      WHEN (length({digits}) - i) % 2 = 1 THEN CAST(substring({digits}, i, 1) AS INT)
      ELSE CAST(substring({digits}, i, 1) AS INT) * 2 - CASE WHEN substring({digits}, i, 1) >= '5' THEN 9 ELSE 0 END END) % 10) % 10 AS STRING)"""


def _mod97(text: str) -> str:
    """The remainder of an account number read as decimal, letters as 10 to 35."""
    c = f"substring({text}, i, 1)"
    return f"""aggregate(sequence(1, length({text})), 0, (r, i) -> CASE
      WHEN {c} RLIKE '[0-9]' THEN (r * 10 + CAST({c} AS INT)) % 97 ELSE (r * 100 + ascii({c}) - 55) % 97 END)"""


def _made(syllables: str, count: str, hex_: str) -> str:
    words = {s: f"array({', '.join(map(_quoted, w))})" for s, w in SYLLABLES.items()}
    pick = " ".join(f"WHEN '{s}' THEN element_at({a}, {_value(hex_, 'i')} % {len(SYLLABLES[s])} + 1)" for s, a in words.items())
    return f"initcap(array_join(transform(sequence(1, {count}), i -> CASE {syllables} {pick} END), ''))"


def surrogate(key: str) -> Column:
    """The surrogate of (type, canon, attempt), in canonical form."""
    k = _quoted(key)

    def h(what: str) -> str:
        blocks = [f"sha2(concat_ws('|', {k}, type, {what}, attempt, '{b}'), 512)" for b in range(3)]
        return f"concat({', '.join(blocks)})"

    x = h("canon")
    at, domain = "instr(canon, '@')", "substring(canon, instr(canon, '@') + 1)"
    host, top = f"substring_index({domain}, '.', size(split({domain}, '[.]')) - 1)", f"substring_index({domain}, '.', -1)"
    # A domain has one surrogate whoever the address belongs to: coreference of hosts.
    host_hash = f"concat(sha2(concat_ws('|', {k}, 'host', {domain}, '0'), 512), sha2(concat_ws('|', {k}, 'host', {domain}, '1'), 512), sha2(concat_ws('|', {k}, 'host', {domain}, '2'), 512))"
    # What stands before the sign keeps its length up to the 64 characters that an address may have there.
    email = f"concat({_shaped(f'substring(canon, 1, least({at} - 1, 64))', x)}, '@', {_shaped(host, host_hash)}, '.', {top})"
    lead = "CASE WHEN canon LIKE 'AKIA%' OR canon LIKE 'ghp!_%' ESCAPE '!' THEN 4 ELSE 3 END"
    access = f"concat(substring(canon, 1, {lead}), {_shaped(f'substring(canon, {lead} + 1)', x)})"
    octets = ", ".join(f"CAST({_value(x, str(i))} % 254 + 1 AS STRING)" for i in range(1, 5))
    card = f"concat(substring(canon, 1, 1), {_shaped('substring(canon, 2, length(canon) - 2)', x)})"
    rest = _shaped("substring(canon, 5)", x)
    checked = f"lpad(CAST(98 - {_mod97('z.whole')} AS STRING), 2, '0')"
    iban = f"element_at(transform(array(named_struct('rest', {rest}, 'whole', concat({rest}, substring(canon, 1, 2), '00'))), z -> concat(substring(canon, 1, 2), {checked}, z.rest)), 1)"
    ssn = f"concat(CAST({_value(x, '1')} % 8 + 1 AS STRING), {_shaped('substring(canon, 2)', x)})"
    # The last ten digits are replaced (all but one where there are fewer); what stands before is the country.
    front = "greatest(least(length(canon) - 10, 3), 0)"
    phone = f"concat(substring(canon, 1, {front}), CAST({_value(x, '1')} % 8 + 2 AS STRING), {_shaped(f'substring(canon, {front} + 2)', x)})"
    sx, sg = "split(type, ':')[1]", "split(type, ':')[2]"
    lists = " ".join(f"WHEN '{s}:{g}' THEN element_at(array({', '.join(map(_quoted, n))}), {_value(x, '1')} % {len(n)} + 1)" for (s, g), n in GIVEN.items())
    either = " ".join(
        f"WHEN '{s}:any' THEN element_at(array({', '.join(map(_quoted, GIVEN[s, 'male'] + GIVEN[s, 'female']))}), {_value(x, '1')} % {len(GIVEN[s, 'male'] + GIVEN[s, 'female'])} + 1)" for s in SYLLABLES
    )
    ends = " ".join(f"WHEN '{s}' THEN CASE {sg} WHEN 'male' THEN '{m}' WHEN 'female' THEN '{f}' ELSE '' END" for s, (m, f) in ENDINGS.items())
    given = f"CASE WHEN attempt = 0 THEN CASE concat({sx}, ':', {sg}) {lists} {either} END ELSE concat({_made(sx, 'attempt + 1', x)}, CASE {sx} {ends} END) END"
    surname = _made(sx, "attempt + 3", x)
    return F.expr(f"""CASE type
      WHEN 'email' THEN {email} WHEN 'key' THEN {access} WHEN 'ip' THEN concat_ws('.', {octets})
      WHEN 'card' THEN element_at(transform(array({card}), d -> concat(d, {_luhn('d')})), 1)
      WHEN 'iban' THEN {iban} WHEN 'ssn' THEN {ssn} WHEN 'phone' THEN {phone}
      ELSE CASE WHEN type LIKE 'given%' THEN {given} ELSE {surname} END END""")


#: An entity is drawn again at most so often.
ATTEMPTS = 64


def distinct_surrogates(atoms: DataFrame, key: str) -> DataFrame:
    """type, canon, attempt, core for every distinct entity; no two of one kind share a core, none is a real entity.

    An entity whose surrogate is real or taken (by a settled one, or by one of smaller hash drawn at
    the same time) is drawn again with the next attempt; what is settled stays. So only those drawn
    again are compared with what is there. Without room for all (fewer possible surrogates than
    entities) this fails after ATTEMPTS rounds.
    """
    kind = F.split("type", ":")[0]
    real = saved(atoms.where("type <> 'kept'").select("type", "canon").distinct().withColumn("kind", kind), "pii-real")
    names = real.select("kind", F.col("canon").alias("as_real")).distinct()
    columns = ("type", "canon", "kind", "attempt", "core", "low")
    settled = real.withColumn("attempt", F.lit(0)).withColumn("core", F.lit("")).withColumn("low", F.lit("")).select(*columns).limit(0)
    todo = real.withColumn("attempt", F.lit(0))
    for _ in range(ATTEMPTS):
        drawn = saved(todo.withColumn("core", surrogate(key)).withColumn("low", F.lower("core")).select(*columns), "pii-drawn")
        first = drawn.groupBy("kind", "low").agg(F.min(F.struct(F.xxhash64("canon").alias("h"), "type", "canon")).alias("first"))
        rows = drawn.withColumn("as_real", F.when(F.col("kind").isin("key", "iban", "ip"), F.col("core")).otherwise(F.col("low")))
        rows = rows.join(first, ["kind", "low"]).join(names.withColumn("real", F.lit(True)), ["kind", "as_real"], "left")
        rows = rows.join(settled.select("kind", "low", F.lit(True).alias("taken")), ["kind", "low"], "left")
        good = F.col("real").isNull() & F.col("taken").isNull() & (F.col("first.type") == F.col("type")) & (F.col("first.canon") == F.col("canon"))
        judged = saved(rows.select(*columns, good.alias("good")), "pii-judged")
        settled = settled.unionByName(judged.where("good").select(*columns))
        todo = judged.where("NOT good").select("type", "canon", "kind", (F.col("attempt") + 1).alias("attempt"))
        if todo.isEmpty():
            return settled.select("type", "canon", "attempt", "core")
    raise ValueError("more entities of a kind than there are surrogates")


def rendered() -> Column:
    """The surrogate in the spelling of the occurrence: its punctuation, spaces and capitals."""
    digits = """aggregate(sequence(1, length(raw)), named_struct('out', '', 'at', 1), (s, i) -> CASE
      WHEN substring(raw, i, 1) RLIKE '[0-9]' THEN named_struct('out', concat(s.out, substring(core, s.at, 1)), 'at', s.at + 1)
      ELSE named_struct('out', concat(s.out, substring(raw, i, 1)), 'at', s.at) END, s -> s.out)"""
    spaced = digits.replace("RLIKE '[0-9]'", "<> ' '")
    cased = """array_join(transform(sequence(1, length(core)), i -> CASE WHEN substring(raw, i, 1) RLIKE '[A-Z]' THEN upper(substring(core, i, 1)) ELSE substring(core, i, 1) END), '')"""
    return F.expr(f"""CASE WHEN type = 'kept' THEN raw WHEN type IN ('card', 'ssn', 'phone') THEN {digits}
      WHEN type = 'iban' THEN {spaced} WHEN type = 'email' THEN {cased}
      WHEN (type LIKE 'given%' OR type LIKE 'surname%') AND length(raw) > 1 AND raw = upper(raw) THEN upper(core) ELSE core END""")


def replace_private(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, text with surrogates, n_entities.

    A null text counts as empty, an empty table gives no rows, repeated rows give repeated rows with
    the same surrogates, other columns, also those named like results, are ignored. Texts of any length
    are read whole. Null ids stay null. The same key gives the same surrogates again for
    the same set of documents; without the key they can't be traced back.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    # The texts are scanned once; what was found is written with them.
    rows = rows.withColumn("found", F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).withColumn("row", F.monotonically_increasing_id())
    rows = saved(rows, "pii-found")
    clean = rows.where("size(found) = 0").select("id", "text", F.lit(0).alias("n_entities"))
    hits = rows.where("size(found) > 0")
    atoms = saved(entities(hits.select("row", "found")), "pii-atoms")
    known = distinct_surrogates(atoms, key)
    parts = atoms.join(known, ["type", "canon"], "left").select("row", "pos", F.struct("part", rendered().alias("s")).alias("p"))
    whole = parts.groupBy("row", "pos").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    whole = whole.select("row", F.struct("pos", F.array_join(F.col("ps.s"), "").alias("s")).alias("w"))
    # The entities of one document: no more than its text holds.
    by_row = whole.groupBy("row").agg(F.sort_array(F.collect_list("w")).alias("ws"))
    done = hits.select("row", "id", "text", F.split("text", ANY, -1).alias("between")).join(by_row, "row")
    text = F.array_join(F.transform("between", lambda b, i: F.concat(b, F.coalesce(F.try_element_at(F.col("ws.s"), i + 1), F.lit("")))), "")
    done = done.select("id", text.alias("text"), F.size("ws").alias("n_entities"))
    return clean.unionByName(done).select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_entities")
