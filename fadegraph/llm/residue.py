"""Template residue, filler, error pages and notices that ask for scripts.

Texts are cut into segments (lines, sentences, markup).  Addresses, dates and
numbers are masked, and masked segments are grouped by hash over all documents
and sources, exactly.  A segment in at least ``RECUR`` documents of ``SOURCES``
sources recurs.  Recurring segments that stand, in at least ``BARE`` of their
documents and in ``RECUR`` different texts, with at most ``HEADING`` words of
anything that does not recur are boilerplate: messages, filler, page furniture.  Sentences of real texts recur
too, but stand among words that do not.

Rules then say which boilerplate is a message.  They know no wordings but classes
of words (what fails, how it fails, scripts, what to do with them, filler): two
classes that belong together are a strong sign, one word a weak one.  Boilerplate
needs a weak sign.  A segment that is no boilerplate needs a strong one, and only
its words of those classes and of grammar are then taken away, since it may quote;
with more than ``QUOTED`` of other words it does quote, and has no sign.

A document is residue if a template field is unfilled, or if it has a message
and at most ``HEADING`` words are left without messages and boilerplate (a
heading or a footer).  Placeholders in code, in backticks or in a sentence about
templates are mentions.

The rows that go through a shuffle are hashes and small numbers, combined per
(segment, source) on the map side.  The ``HOT`` most frequent groups are joined on the map side
(a bounded table); the rest is shuffled and has no hot key.

Defined cases: null, empty and blank texts are not residue; each row is judged
by itself, repeated rows give repeated rows only as often as doc_id and text
differ; a null doc_id is kept; a null source is a source of its own; an empty
table gives no rows; further columns are ignored.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fadegraph.sources import materialise

HOT, HEADING, RECUR, SOURCES, BARE, QUOTED = 8_192, 7, 3, 2, 0.8, 0.4

# Beginnings of words by class, in English, French, German and Spanish.
CLASSES = {
    # what fails
    "thing": """page pagina página seite site website webseite sitio server serveur servidor service dienst servicio session sitzung sesión
        access accès zugriff acceso request requête anfrage solicitud petición connection connexion verbindung conexión content contenu contenido inhalt
        workspace note document url resource ressource recurso gateway proxy account compte konto cuenta link lien enlace upstream délai tiempo zeit
        error erreur fehler database datenbank""",
    # how it fails
    "failure": """denied refus verweiger denegad forbidden interdit verboten prohibid expired expir abgelaufen caducad unavailable indisponible verfügbar
        disponible unterbrochen missing introuvable gefunden encontrad found exist existier existe moved déplacé verschoben movid reset réinitialis
        timeout timed dépassé überschritten zeitüberschreitung agotó agotad failed échou fehlgeschlagen fall loaded chargé geladen cargad interne internal
        intern unauthorized maintenance wartung mantenimiento longer permission autoris berechtig permiso answered many temporarily momentanément vorübergehend
        gewünscht demandé solicitad requested asked wrong produit survenue aufgetreten ocurrid broken blocked bad""",
    "script": "javascript js script skript cookie noscript",
    # what is to be done with scripts
    "switch": """enabl activ aktivier turn allow permit permett permít autoris erlaub disabl désactiv deaktivier desactiv abgeschaltet ausgeschaltet off blocked
        bloqué blockiert bloquead need nécessit benötig braucht necesit besoin require erforderlich requis requier support unterstütz browser navigateur
        navegador run execut exécut ausführ ejecut check überprüf reload recharg neu continu fortzufahren adblock blocker""",
    # weak signs of a message that waits or apologises
    "wait": """oops sorry désolé entschuldigung lo retry réessay erneut vuelva reintent again signin reconnect anmelden loading chargement lädt cargando
        wait patient bitte veuillez refresh shortly soon bientôt kürze próximamente construction bau construcción""",
}
# Names of states of HTTP and what filler says of itself, as whole phrases.
PHRASES = """
bad request|unauthorized|payment required|forbidden|not found|method not allowed|not acceptable|request timeout|too many requests|payload too large
internal server error|not implemented|bad gateway|proxy error|service unavailable|service temporarily unavailable|gateway timeout|access denied
gibt es nicht mehr|does not exist|n existe pas|no existe|something went wrong|an error occurred|une erreur est survenue|ein fehler ist aufgetreten|ha ocurrido un error|interner serverfehler
lorem ipsum|placeholder|place holder|sample text|dummy text|filler text|example text|body copy|your text|text here|content here|text goes here|insert text|type something|write something|write this
add text|add content|coming soon|to follow|to be added|to be announced|to be completed|to be confirmed|to be determined|to be written|tbd|tba|todo|under construction
work in progress|platzhalter|beispieltext|blindtext|mustertext|text folgt|inhalt folgt|folgt in kürze|in kürze|noch zu schreiben|noch zu ergänzen|in arbeit|im aufbau|wird ergänzt
hier steht|faux texte|texte d exemple|exemple de texte|texte ici|contenu ici|à venir|à rédiger|à compléter|à définir|bientôt disponible|en construction|en cours de rédaction
texto de ejemplo|texto de relleno|texto de muestra|aquí va|texto aquí|contenido aquí|por redactar|por completar|por definir|pendiente de redacción|próximamente|disponible próximamente|en construcción
asdf|qwer|qwerty|blah blah|bla bla|xxx xxx|foo bar
"""
# Words of the usual filler Latin.
LATIN = """
lorem ipsum dolor sit amet consectetur adipiscing elit eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud
exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur
excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum sed
""".split()
# Words of grammar and of page furniture in the four languages.
GRAMMAR = frozenset("""
a an the this that these it its of to in on at for from by with without and or but if is are was were be been being has have had will would can could may not no
do does did you your we our us they their them there here then please some any all only while when what how too up down out off over after before back s t re
le la les l un une des du de d ce cet cette ces ceci cela il elle ils elles y et ou mais si est sont été être a ont avez vous votre vos nous notre n ne pas plus à au aux en
dans sur pour par avec sans se s qu que qui
der die das den dem des ein eine einen einer eines und oder aber wenn ist sind war waren wird werden wurde kann können nicht kein keine es er sie sie ihr ihre ihrem ihren
wir uns unser im in an am auf zu zum zur für von vom mit ohne nach bei um mehr nur diese dieser dieses
el los las un unos unas y o pero si es son fue ser está están ha han se su sus nuestro no al del en con sin por para que lo más esta este esto
dies das esto eso
menu search help home back next retry reload refresh reference request id status detail details code message notes notas accueil suche hilfe zurück inicio ayuda buscar volver cancel ok close null true false
""".split())
# What template fields are called, in four languages; compared by their letters only.
FIELD = """
date node_label workspace summary next_step title first_name name value reviewer unit source owner project nom responsable unité projet datum
projekt wert kurzfassung espace zuständig prénom espacio titel einheit título vorname bereich quelle titre valor valeur résumé fecha origen
resumen nombre origine unidad proyecto user last_name email company address customer client product order order_id invoice amount price phone number
city country department position role subject signature recipient sender link url location event time
kunde produkt firma adresse betrag telefon ort client produit société montant téléphone ville cliente producto empresa dirección importe teléfono ciudad
""".split()
# Words of instructions around a field, and of sentences about templates.
_ASK = (
    r"insert|add|enter|your|fill in|to be added|goes here|insérer|votre|saisir|à compléter|ihre?|hier|eintragen|einfügen|folgt|"
    r"su|insertar|escriba|por completar|aquí|ici|here"
)
_OF = r"customer|client|company|order|product|user|full|first|last|contact|project|recipient|sender|event|invoice|phone|email"
TALK = r"(?iu)template|mail builder|gabarit|vorlage|plantilla|placeholder"
#: How every unfilled field begins; cheap to look for.
_MARK = rf"(?=[{{$<\[#%«@_:XN(])(?:\{{[\{{%\p{{L}}]|\$[\{{\[]|<[%?\p{{L}}]|\[[\[.\p{{L}}]|[#%]\p{{L}}|«|@@|__|::|XXXX|N\.N\.|\((?iu:(?:your |{_ASK}|\p{{L}}+[ _](?:\p{{L}}+ )?(?:{_ASK}))))"


def _fields() -> str:
    return "|".join(sorted({re.sub("_", r"[_ ]?", f) for f in FIELD}, key=lambda f: (-len(f), f)))


def _placeholder() -> str:
    """Unfilled fields.  Wrappers no prose uses hold any identifier; common brackets hold a field's name or ask for one."""
    f = _fields()
    word = r"[\p{L}_][\p{L}\p{N}_.]*(?: [\p{L}_]+)?"
    asked = rf"(?:(?:{_ASK}) )(?:{f})(?: (?:{_ASK}))?|(?:{f}) (?:{_ASK})"
    return (
        rf"(?iu)\{{\{{ ?{word} ?\}}\}}|\$\{{ ?{word} ?\}}|\$\[ ?{word} ?\]|<%=? ?{word} ?%>|\{{% ?{word} ?%\}}|\[\[ ?{word} ?\]\]|@@{word}@@"
        rf"|(?<![\p{{L}}_])__{word}__(?![\p{{L}}_])|::(?:{f})::|%(?:{f})%|#(?:{f})#|«(?:{f})»|(?<!\{{)\{{(?:{f})\}}"
        rf"|[\[<(](?:your )?(?:{asked})(?: (?:{_ASK}))?[\]>)]|[\[<](?:(?:{_OF})[_ ])?(?:{f})[\]>]|(?<![\p{{L}}_])_{{4,}}(?![\p{{L}}_])|XXXX+|<\?>|\[TBD\]|\[\.\.\.\]"
        rf"|(?<!\p{{L}})N\.N\.(?!\p{{L}})"
    )


def _tree(words: list[str], whole: bool = False) -> str:
    """An alternation with shared beginnings, so that most places of a text fail at one letter.

    Without ``whole`` a word that begins another stands for both; with it each is matched to its end, the longest first.
    """
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        heads.setdefault(w[:1], []).append(w[1:])
    ends = heads.pop("", None) is not None
    if ends and not (whole and heads):
        return ""
    parts = [re.escape(h) + _tree(rest, whole) for h, rest in heads.items()]
    return parts[0] if len(parts) == 1 and not ends else "(?:" + "|".join(parts) + ")" + "?" * ends


def _begins(*classes: str) -> str:
    """A word of the classes; texts stand in lower case between blanks."""
    return "(?<= )" + _tree([w for c in classes for w in CLASSES[c].split()])


def _whole() -> list[str]:
    return [p.strip() for line in PHRASES.strip().split("\n") for p in line.split("|")]


#: Any sign at all: a word of a class, of a phrase or of the filler Latin; a phrase three times over.
_SIGN = r"(?<= )(?:" + _tree([w for c in CLASSES for w in CLASSES[c].split()] + [p.split(" ")[0] if len(p.split(" ")[0]) > 3 else p for p in _whole()] + LATIN) + ")"
_AGAIN = r"(?<= )((?:\p{L}++ ){1,4})\1\1"


#: By their shape alone: frames of a stack trace, and the path to a page.
_FRAME = r"(?<!\S)at \S{1,80} ?\([^()]{0,80}\d\)"
_SHAPE = r"^\s*(?:(?:[^<>|.!?]{1,30} [>»›] ){1,6}[^<>|.!?]{1,30})\s*$"


def _addresses(segment: Column, by: str) -> Column:
    """Addresses replaced; looked for only where there may be one, as each place of a text is a beginning."""
    web = F.when(segment.contains("://"), F.regexp_replace(segment, r"https?://\S+", by)).otherwise(segment)
    return F.when(segment.contains("@"), F.regexp_replace(web, r"(?<!\S)[^\s@]{1,64}@[^\s@]{1,255}", by)).otherwise(web)


def normal(segment: Column) -> Column:
    """Words of a segment between single blanks, in lower case: no markup, addresses, dates, numbers or signs."""
    bare = F.when(segment.rlike("[<@(]|://"), F.regexp_replace(
        _addresses(segment, " "), rf"<[^<>]{{0,200}}>|{_FRAME}", " ")).otherwise(segment)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(bare), r"[^\p{L}\p{M}]+", " ")), F.lit(" "))


def _count(c: Column) -> Column:
    """Words between single blanks."""
    return F.length(c) - F.length(F.replace(c, F.lit(" "))) - F.lit(1)


def _without_code(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)```.*?```|`[^`\n]*`", " ")


def segments(docs: DataFrame, doc_id: str, text: str, source: str | None = None) -> DataFrame:
    """(id, key, source, seg, norm, words): one row per segment with its words; key tells texts apart."""
    return (
        docs.select(F.col(doc_id).alias("id"), F.col(text).alias("_t"), (F.col(source) if source else F.lit(None)).cast("string").alias("source"))
        .filter(F.col("_t").rlike(r"[^\s\p{Z}\p{C}]"))
        .withColumn("key", F.xxhash64("_t"))
        .withColumn("seg", F.explode(F.split("_t", r"\R+|(?<=[.!?…])[\s\p{Z}]+(?![\p{Ll}])")))
        .filter(F.col("seg").rlike(r"\S")).select("id", "key", "source", "seg")
        .withColumn("norm", normal(F.col("seg"))).withColumn("words", F.when(F.col("norm") == "  ", 0).otherwise(_count(F.col("norm"))))
    )


def _masked(seg: Column) -> Column:
    """A segment as it is reported: dates, numbers and addresses masked, one blank between words."""
    return F.trim(F.regexp_replace(F.regexp_replace(_addresses(seg, "@"), r"\p{N}+(?:[.,:/-]\p{N}+)*", "0"), r"[\s\p{Z}]+", " "))


def unfilled(seg: Column) -> Column:
    """Whether a template field stands unfilled in a segment."""
    return seg.rlike(_MARK) & _without_code(seg).rlike(_placeholder()) & ~seg.rlike(TALK)


def repeated(norm: Column, words: Column) -> Column:
    """Whether up to four words stand three times running; only where two words or more occur again it is looked for."""
    distinct = F.size(F.array_distinct(F.split(F.trim(norm), " ")))
    return F.when(words >= distinct + 2, norm.rlike(_AGAIN)).otherwise(False)


def strength(norm: Column, again: Column) -> Column:
    """0 to 2: how strong the signs of a message are in normalised words, of which some may be repeated."""
    has = lambda *c: norm.rlike(_begins(*c))
    phrase = norm.rlike(f"(?<= ){_tree(_whole(), True)}(?= )")
    latin = norm.rlike(rf"(?<= )(?:{_tree(LATIN, True)} ){{4}}")
    strong = phrase | latin | again | (has("thing") & has("failure")) | (has("script") & has("switch"))
    return F.when(strong, 2).when(has(*CLASSES) | norm.rlike(f"(?<= ){_tree(LATIN, True)} "), 1).otherwise(0)


def own_words(norm: Column) -> Column:
    """How many words are of no class, no phrase, no filler and no grammar."""
    left = F.regexp_replace(norm, f"(?<= ){_tree(_whole(), True)}(?= )", "")
    known = rf"(?:{_tree([w for c in CLASSES for w in CLASSES[c].split()])}\p{{L}}*|{_tree([*GRAMMAR, *LATIN], True)})"
    left = F.regexp_replace(F.regexp_replace(left, " +", " "), rf"(?<= ){known}(?= )", "")
    return _count(F.concat(F.lit(" "), F.trim(F.regexp_replace(left, " +", " ")), F.lit(" "))) * (F.trim(left) != "").cast("int")


def _rows(docs: DataFrame, doc_id: str, text: str, source: str | None) -> DataFrame:
    """One row per segment, written: id, key, source, h and m (its hash), words, own (words not taken away), power, open."""
    s = segments(docs, doc_id, text, source).withColumn("again", repeated(F.col("norm"), F.col("words")))
    s = s.withColumn("sign", F.col("again") | F.col("norm").rlike(_SIGN))
    sign = F.col("sign")
    s = s.select(
        "id", "key", "source", F.xxhash64("norm").alias("h"), F.xxhash64(F.lit(7), "norm").alias("m"), "words",
        F.when(sign, strength(F.col("norm"), F.col("again"))).otherwise(0).alias("power"),
        F.when(F.col("seg").rlike(_SHAPE), 0).when(sign, own_words(F.col("norm"))).otherwise(F.col("words")).alias("own"),
        unfilled(F.col("seg")).alias("open"),
    )
    quotes = (F.col("own") > 4) & (F.col("own") > QUOTED * F.col("words"))
    s = s.withColumns({"power": F.when(quotes, F.least("power", F.lit(1))).otherwise(F.col("power")), "own": F.when(quotes, F.col("words")).otherwise(F.col("own"))})
    return materialise(s, "segments")


def _recurring(rows: DataFrame) -> DataFrame:
    """(h, m, n, sources) of segments in ``RECUR`` places of ``SOURCES`` sources; hot ones are combined per source on the map side."""
    by_source = rows.filter("words > 0").groupBy("h", "m", "source").agg(F.count("*").alias("n"))
    return by_source.groupBy("h", "m").agg(F.sum("n").alias("n"), F.count("*").alias("sources")).filter(
        (F.col("n") >= RECUR) & (F.col("sources") >= SOURCES))


def _with(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with those of ``found`` (h, m, n, ...) of the same segment; the most frequent ones on the map side."""
    hot = F.broadcast(found.orderBy(F.desc("n"), "h", "m").limit(HOT))
    near = rows.join(hot, ["h", "m"])
    far = rows.join(hot.select("h", "m"), ["h", "m"], "left_anti").join(found, ["h", "m"])
    return near.unionByName(far)


def residue(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str | None = "source") -> DataFrame:
    """(doc_id, reason): documents that are residue; reason is 'template' or 'message'."""
    rows = _rows(docs, doc_id, text, source)
    recurring = materialise(_recurring(rows), "recurring")
    size = rows.groupBy("id", "key").agg(F.sum("words").alias("total"), F.max("open").alias("open"), F.sum(F.col("words") - F.col("own")).alias("cut"), F.max("power").alias("power"))
    some = _with(rows.select("id", "key", "h", "m", "own", "power"), recurring)
    # what is left of a document if all that recurs and all strong words are taken away
    again = some.groupBy("id", "key").agg(
        F.sum("own").alias("more"),
        F.collect_list(F.struct("h", "m", "n", "own", "power")).alias("segs"),
    )
    docs_ = size.filter("open OR power > 0").join(again, ["id", "key"], "left")
    left = F.col("total") - F.col("cut") - F.coalesce("more", F.lit(0))
    cand = materialise(docs_.filter(F.col("open") | (left <= HEADING)), "candidates")
    each = cand.filter(left <= HEADING).select("id", "key", F.explode("segs").alias("s")).select("id", "key", "s.*")
    plate = materialise(each.groupBy("h", "m").agg(F.count("*").alias("bare"), F.max("n").alias("n"), F.count_distinct("key").alias("texts")).filter(
        (F.col("bare") >= BARE * F.col("n")) & (F.col("texts") >= RECUR)).select("h", "m", "n"), "boilerplate")
    plain = _with(each.drop("n"), plate).groupBy("id", "key").agg(F.sum("own").alias("taken"), F.max("power").alias("weak"))
    rest = F.col("total") - F.col("cut") - F.coalesce("taken", F.lit(0))
    message = (rest <= HEADING) & ((F.col("power") == 2) | (F.coalesce("weak", F.lit(0)) > 0))
    judged = cand.join(plain, ["id", "key"], "left").filter(F.col("open") | message)
    return judged.select(F.col("id").alias(doc_id), F.when(F.col("open"), "template").otherwise("message").alias("reason"))


def messages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(message, n, sources): masked segments with a strong sign or an open field, found at least ``RECUR`` times."""
    s = segments(docs, doc_id, text, source).withColumn("again", repeated(F.col("norm"), F.col("words")))
    sign = (F.col("again") | F.col("norm").rlike(_SIGN)) & (strength(F.col("norm"), F.col("again")) == 2)
    told = s.filter(sign | unfilled(F.col("seg"))).select(_masked(F.col("seg")).alias("message"), "source")
    by_source = told.groupBy("message", "source").agg(F.count("*").alias("n"))
    return by_source.groupBy("message").agg(F.sum("n").alias("n"), F.count("source").alias("sources")).filter(F.col("n") >= RECUR)
