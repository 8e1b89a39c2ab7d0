r"""Template residue and error pages: placeholders by a grammar per delimiter, filler, error messages, script notices.

Each delimiter style has its own grammar of what an unfilled slot looks like ({{name}}, {% if name %}, ${NAME}, #{name},
<%= name %>, [[NAME]], %(name)s, %NAME%, __NAME__, @@name@@, <name>, {3}, [insert name here], XX.XX.20XX ...). Code blocks
are taken out beforehand. A slot that stands in a passage on templates (words such as "placeholder", "syntax", "variable"
close by, with few slots in the text) is a tutorial's and discounted; from DENSITY slots per hundred words on, the text
is a template whatever it says. Filler is known by repetition (a cycle of up to CYCLE words going round for REPEATED words, the
same short sentence three times running), by the density of pseudo-Latin words, and by what it says of itself. Messages and
notices are known by whole phrases and by a small grammar of requests (switch on, accept, reload, wait) aimed at the reader's
browser or the page, so that members who merely name an error or JavaScript are no cases.

Defined results: null and empty texts are no cases; case, accents, kinds of white space and text read in a wrong code page don't
matter; any length of text is examined whole, in one pass over the rows (no shuffle).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrolith.functions.text import unscramble

DENSITY = 3.0  # slots per hundred words from which a text about templates counts as a template
NEAR = 80  # characters on either side in which a tutorial's words count

_NAME = r"[A-Za-zÀ-ÿ][\wÀ-ÿ.\- ]{0,40}"
_ID = r"[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ0-9]*(?:[_. ][A-Za-zÀ-ÿ0-9]+){0,4}"
# The grammars of unfilled slots, by delimiter.
SLOTS = {
    "curly": rf"\{{\{{\s*{_NAME}\s*\}}\}}|\{{%-?\s*(?:if|for|set|block|include|endif|endfor)?\s*{_NAME}\s*-?%\}}",
    "dollar": rf"\$\{{\s*{_ID}\s*\}}|#\{{\s*{_ID}\s*\}}",
    "server": rf"<%=?\s*{_ID}\s*%>|&lt;%?=?\s*{_ID}\s*%?&gt;",
    "angle": rf"<<?\s*(?!/?(?:p|b|i|u|br|hr|li|ul|ol|td|tr|th|em|h\d|div|span|body|html|head|table|strong|sub|sup|pre|code|a)\s*/?>){_ID}\s*>>?",
    "square": rf"\[\[\s*{_ID}\s*\]\]|\[[A-ZÀ-Ý][A-ZÀ-Ý0-9]*(?:_[A-ZÀ-Ý0-9]+)+\]|\[(?i:your|votre|vos|ihre?|tu|su) {_NAME}\]",
    "percent": rf"%\({_ID}\)[sd]|%[A-ZÀ-Ý][A-ZÀ-Ý0-9]*(?:_[A-ZÀ-Ý0-9]+)*%",
    "marks": rf"__[A-ZÀ-Ý][A-ZÀ-Ý0-9]*(?:_[A-ZÀ-Ý0-9]+)*__|@@?[A-Za-zÀ-ÿ]+(?:_[A-Za-zÀ-ÿ]+)*@@?(?!\w)",
    "brace": r"\{\d{1,2}\}|(?<![{$#])\{[A-Za-zÀ-ÿ]+(?:[_. ][A-Za-zÀ-ÿ]+)*\}(?!\})",
    "told": r"(?i)\[(?:[^\[\]]{0,60}\b(?:TBC|TBD|TODO|n\.?\s?n\.?\s?b\.?)|insert\b[^\[\]]{0,60}|ins[ée]rer\b[^\[\]]{0,60}|[^\[\]]{0,60}\b(?:einf[üu]gen|einsetzen|erg[äa]nzen|nachtragen)|[^\[\]]{0,60}[àa] (?:compl[ée]ter|remplir|pr[ée]ciser|ins[ée]rer)|[^\[\]]{0,60}to be (?:completed|confirmed|filled|inserted|added)|[^\[\]]{0,60}(?:bitte )?ausf[üu]llen|[^\[\]]{0,60}folgt|placeholder|platzhalter)[^\[\]]{0,20}\]",
    "blank": r"\bXX[./-]XX[./-](?:20)?XX(?:XX)?\b|\b(?:XXXXX+|xxxxx+)\b|\b(?:Mr/Mrs|M\./Mme|Herr/Frau)\s+X+\b|_{5,}",
}
_SLOT = re.compile("|".join(f"(?:{x.removeprefix('(?i)')})" if not x.startswith("(?i)") else f"(?i:{x[4:]})" for x in SLOTS.values()))
_CODE = re.compile(r"```.*?```|~~~.*?~~~|<(pre|code)\b.*?</\1>|`[^`\n]{1,200}`", re.S | re.I)
_TUTORIAL = re.compile(r"\b(?:syntax|placeholders?|variables?|template (?:engine|language|syntax)|for example|e\.g\.|platzhalter|beispielsweise|zum beispiel|par exemple|modèle de page|moteur de gabarit|gabarits?)\b", re.I)
# Filler.
_FILLER = re.compile(
    r"\blorem\s+ipsum\b|\b(?:dummy|sample|filler|placeholder) (?:text|paragraph|copy)\b.{0,40}\b(?:layout|publication|here|replace)|\bbody copy here\b|\btext to follow\b(?=[.\s]*(?:text to follow|$))"
    r"|\bfaux texte\b|\btexte? [àa] venir\b(?=[.\s]*(?:texte? [àa] venir|$))|\bcontenu ici\b|\bparagraphe d'exemple\b|\bblindtext\b|\bmusterabsatz\b|\bhier steht sp[äa]ter inhalt\b|\btext folgt\b(?=[.\s]*(?:text folgt|$))"
    r"|(?:\bx{3,}\b\s*){3,}", re.I)  # fmt: skip
# Words of the usual pseudo-Latin filler; PSEUDO different ones within WINDOW words are no speech.
_PSEUDO = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure "
    "reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum vestibulum curabitur pellentesque habitant morbi tristique senectus netus".split())  # fmt: skip
PSEUDO, WINDOW = 6, 12
CYCLE, REPEATED = 3, 8  # words of a cycle, and of a run of it, that no member says
# Error messages of sites and servers, as whole phrases.
_ERROR = re.compile(
    r"\btoo many requests,? (?:please )?try again\b|\bdatabase connection (?:lost|failed)|\baccess denied,? your session\b|\byour session has expired\b|\bbad gateway\b|\bgateway time-?out\b|\bthe request timed out\b|\binternal server error\b"
    r"|\bthe [\w ]{0,20}service is (?:temporarily )?unavailable\b|\bservice temporarily unavailable\b|\byou are not authori[sz]ed to (?:open|view|read|access)\b|\bwe can(?:not|'t) display the [\w ]{1,20} right now\b|\b(?:this|the|that) (?:\w+ ){1,2}(?:was not found|could not be found|cannot be found|does not exist)(?: on this server)?(?=\s*[.!]?\s*$)"
    r"|\b(?:error|http) \d{3}\s*[:|–—-]|\b\d{3} (?:gone|not found|forbidden|bad gateway|internal server error|service unavailable)\b"
    r"|\btrop de requ[êe]tes,? r[ée]essayez\b|\bconnexion (?:à|a) la base (?:de donn[ée]es )?(?:perdue|interrompue)|\bbase de donn[ée]es (?:perdue|injoignable|inaccessible|d[ée]connect[ée]e)|\bacc[èe]s refus[ée],? votre session\b|\bvotre session a expir[ée]|\bmauvaise passerelle\b|\bpasserelle (?:incorrecte|invalide|d[ée]faillante)\b|\bd[ée]lai d'attente d[ée]pass[ée]|\berreur interne du serveur\b|\ble service est indisponible pour\b|\bvous n'[êe]tes pas autoris[ée]e?s? à (?:ouvrir|lire|voir|consulter)\b|\bimpossible d'afficher (?:la page|le |ce |cette |la )"
    r"|\berreur \d{3}\s*[:|–—-]"
    r"|\bzu viele anfragen,? bitte\b|\bdatenbankverbindung (?:verloren|unterbrochen|fehlgeschlagen)|\bzugriff verweigert,? ihre sitzung\b|\bihre sitzung ist abgelaufen\b|\bzeit[üu]berschreitung der anfrage\b|\binterner serverfehler\b|\b(?:fehlerhaftes|ung[üu]ltiges) gateway\b|\b(?:der|dieser) dienst (?:ist )?[\w ]{0,30}nicht (?:verf[üu]gbar|erreichbar)\b|\bsie sind nicht (?:berechtigt|befugt),? .{0,40}(?:zu [öo]ffnen|zu lesen|einzusehen)|\bk[öo]nnen [\w ]{0,40}(?:derzeit|gerade|zurzeit|momentan|jetzt) nicht (?:anzeigen|darstellen)\b|\bkann [\w ]{0,40}(?:derzeit|gerade|zurzeit|momentan|jetzt) nicht (?:angezeigt|dargestellt) werden"
    r"|\bfehler \d{3}\s*[:|–—-]"
    r"|\b(?:has|have) (?:been )?moved or no longer exists?\b|\bfailed to load\b|\b(?:this|the) \w+ could not be (?:found|loaded)\b|\bif the problem persists,? (?:please )?contact\b|\brequest id:? [0-9a-f]{6,}|\bline \d+ of \w+\.\w+"
    r"|\bn'existe plus ou a [ée]t[ée] d[ée]plac[ée]|\b[ée]chec du chargement\b|\bne peut [êe]tre affich[ée]e? pour l'instant\b|\b(?:ce|cette|le|la) [\w\- ]{2,24}est introuvable\b(?!,)|\bsi le probl[èe]me persiste,? contactez\b|\bligne \d+ de \w+\.\w+"
    r"|\bexistiert nicht mehr\b(?!,)|\bkonnte nicht geladen werden\b|\bwurde nicht gefunden\b(?!,)|\bbei anhaltenden problemen wenden\b|\bzeile \d+ in \w+\.\w+|\bkennung: [0-9a-f]{6,}", re.I)  # fmt: skip
# A sentence of its own that says a thing can't be found.
_MISSING = re.compile(r"^(?:[\w'!¡ ]{0,14}\s*[:|–—-]\s*)?(?:(?:the|this) (?:\w+ ?){1,3} (?:was|could|can)(?: ?not)? (?:be )?(?:not )?found|(?:ce|cette|le|la|l') ?[\w\- ]{1,30} est introuvable|(?:das|der|die|dieser|dieses|diese) [\w\- ]{1,30} (?:wurde )?nicht gefunden|(?:el|la|esta|este) [\w\- ]{1,30} no (?:se ha encontrado|encontrad[ao]|existe)|(?:p[áa]gina|archivo|recurso) no encontrad[ao])\s*[.!]?$", re.I)
# Requests that only a site makes of its reader: what is to be done, and with what.
_REQUEST = re.compile(
    r"\b(?:please )?(?:enable|allow|accept|turn on|switch on|unblock) (?:\w+ ){0,2}cookies\b|\bcookies (?:must|have to|need to) be (?:enabled|allowed|accepted|turned on)|\bchecking (?:your|the) browser\b|\bverify(?:ing)? (?:that )?you are (?:a )?human\b"
    r"|\b(?:please )?(?:reload|refresh) (?:this|the|your) (?:page|browser|window)\b(?! of)|\bsomething went wrong\b[.!:,]|\btry (?:again|reloading) (?:later|in a few (?:moments|minutes))[.!]?\s*(?:$|error|request|if the problem)"
    r"|\b(?:veuillez |merci de )?(?:activer|activez|autoriser|autorisez|accepter|acceptez) (?:les |vos )?(?:t[ée]moins|cookies)\b|\bv[ée]rification de votre navigateur\b|\b(?:veuillez |merci de )(?:recharger|actualiser) (?:la|cette) page\b|\bune erreur (?:est survenue|s'est produite)[.!:]"
    r"|\b(?:bitte )?(?:aktivieren|erlauben|akzeptieren) sie (?:bitte )?(?:die )?cookies\b|\bihr browser wird [üu]berpr[üu]ft\b|\b(?:bitte )?laden sie (?:bitte )?(?:die|diese) seite neu\b|\bein fehler ist aufgetreten[.!:]|\betwas ist schiefgelaufen[.!:]"
    r"|\b(?:active|habilite|acepte|permita) (?:las )?cookies\b|\bcomprobando (?:su|tu) navegador\b|\b(?:recargue|actualice) (?:la|esta) p[áa]gina\b|\bp[áa]gina no encontrada\b|\bse ha producido un error[.!:]", re.I)  # fmt: skip
_SCRIPT = r"(?:java-?\s?script|\bjs\b|\bscripts?\b|\bscripting\b|\bskripte?n?\b)"
_NAMED = re.compile(r"\bscript|java-?\s?script|noscript|\bjs\b|skript")  # of the literals only those at the beginning of a word
# Notices that scripts are required.
_NOTICE = re.compile(
    rf"\bnoscript (?:fallback|content|notice)\b|\b(?:habilite|active|active usted) {_SCRIPT}|{_SCRIPT} (?:est[áa] desactivad|es necesari)"
    rf"|\b(?:enable|activate|turn on|switch on|allow|unblock)\s+{_SCRIPT}|{_SCRIPT} (?:must|has to|needs to|should) be (?:turned|switched) on|{_SCRIPT} (?:must|has to|needs to) be (?:enabled|activated)|{_SCRIPT} (?:is|are) (?:disabled|required|turned off|switched off|off\b)"
    rf"|\b(?:viewer|page|site|view|application|app) (?:requires|needs) {_SCRIPT}|\bbrowser (?:does not|doesn't|cannot) (?:run|support|execute)\b.{{0,20}}{_SCRIPT}|\bbrowser blocks\b.{{0,20}}{_SCRIPT}"
    rf"|\b(?:activer|activez|autoriser|autorisez|r[ée]activez|d[ée]bloquez)\s+(?:les? )?{_SCRIPT}|(?:les? )?{_SCRIPT} (?:doit|doivent) [êe]tre (?:activ|autoris)[ée]|{_SCRIPT} (?:est|sont) (?:d[ée]sactiv|requis|n[ée]cessaire|bloqu)|\b(?:visionneuse|page|vue|application|site) (?:requiert|exige|n[ée]cessite) (?:les? )?{_SCRIPT}|\bnavigateur (?:bloque|n'ex[ée]cute pas)\b.{{0,20}}{_SCRIPT}"
    rf"|\b(?:aktivieren|erlauben|schalten) sie (?:bitte )?{_SCRIPT}|\bsie m[üu]ssen {_SCRIPT} (?:zulassen|aktivieren|einschalten|erlauben)|{_SCRIPT} (?:muss|m[üu]ssen) (?:eingeschaltet|aktiviert|zugelassen)|{_SCRIPT} (?:ist|sind) (?:abgeschaltet|deaktiviert|ausgeschaltet|erforderlich)|\b(?:ansicht|seite|anzeige|anwendung) (?:ben[öo]tigt|braucht|erfordert) {_SCRIPT}|\bbrowser f[üu]hrt .{{0,30}}{_SCRIPT}.{{0,12}} nicht aus|\bbrowser blockiert\b.{{0,20}}{_SCRIPT}", re.I)  # fmt: skip
_BREAK = re.compile(r"(?<=[.!?])\s+|\n+")


# Literals of which every match of a pattern holds one; a text without any needn't be searched.
_LITERALS = {
    "error": ["too many requests", "database connection", "access denied", "session has expired", "gateway", "timed out", "internal server error", "unavailable", "are not authori", "right now", "found", "does not exist",
              "error ", "http ", " gone", " forbidden", "trop de requ", "connexion ", "base de donn", "accès refus", "acces refus", "session a expir", "passerelle", "d'attente d", "erreur ", "service est indisponible",
              "tes pas autoris", "impossible d'afficher", "zu viele anfragen", "datenbankverbindung", "zugriff verweigert", "sitzung ist abgelaufen", "berschreitung der anfrage", "serverfehler", "nicht verf", "nicht erreichbar",
              "nicht berechtigt", "nicht befugt", "nicht anzeigen", "nicht darstellen", "nicht angezeigt", "nicht dargestellt", "fehler ", "moved or no longer", "failed to load", "could not be", "problem persists", "request id", "line ",
              "existe plus ou", "chec du chargement", "no encontrad", "no existe", "no se ha encontrado", "pour l'instant", "introuvable", "me persiste", "ligne ", "existiert nicht mehr", "nicht geladen werden", "gefunden", "anhaltenden problemen", "zeile ", "kennung:"],
    "script": ["script", "js", "skript"],
    "request": ["cookies", "témoins", "temoins", "browser", "human", "reload", "refresh", "went wrong", "try again", "try reloading", "navigateur", "recharge", "actualise", "une erreur", "seite neu", "fehler ist aufgetreten", "schiefgelaufen", "navegador", "recargue", "actualice", "no encontrada", "un error"],
    "filler": ["lorem", "dummy ", "sample ", "filler", "placeholder", "body copy", "text to follow", "faux texte", "venir", "contenu ici", "d'exemple", "blindtext", "musterabsatz", "inhalt", "text folgt", "xxx"],
}
_SIGNS = re.compile(r"[{$#<\[%@&]|__|XX|xxxxx|(?:Mrs|Mme|Frau)\s+X")


def _hollow(words: list[str]) -> bool:
    """Whether words go round in a cycle of up to CYCLE words for REPEATED words and more, or PSEUDO different ones of WINDOW words are pseudo-Latin."""
    if len(words) < REPEATED - CYCLE:
        return False
    at = np.fromiter(map(hash, words), np.int64, len(words))
    for c in range(1, CYCLE + 1):
        least = max(REPEATED, 4 * c) - c  # words in a row that are each the one c words before
        same = at[c:] == at[:-c]
        if same.sum() >= least and (np.diff(np.flatnonzero(np.r_[True, ~same, True])) > least).any():
            return True
    if len(_PSEUDO.intersection(words)) < PSEUDO:
        return False
    return any(len(_PSEUDO.intersection(words[i : i + WINDOW])) >= PSEUDO for i in range(max(1, len(words) - WINDOW + 1)))


def _finder():
    import ahocorasick

    a = ahocorasick.Automaton()
    for x in {x for literals in _LITERALS.values() for x in literals}:
        a.add_word(x, tuple(kind for kind, literals in _LITERALS.items() if x in literals))
    a.make_automaton()
    return a


_FINDER = _finder()


def kinds(text: str | None) -> list[str]:
    """What residue a text holds: 'placeholder', 'filler', 'error', 'script', in this order."""
    if not text:
        return []
    t = unscramble(text)
    out = []
    if _SIGNS.search(t):
        plain = _CODE.sub(" ", t) if "`" in t or "~~~" in t or "<" in t else t
        slots = list(_SLOT.finditer(plain))
        if slots:
            words = max(1, plain.count(" ") + 1)
            dense = 100 * len(slots) / words >= DENSITY and len(slots) > 2
            if dense or any(not _TUTORIAL.search(plain[max(0, m.start() - NEAR) : m.start()] + " " + plain[m.end() : m.end() + NEAR]) for m in slots):
                out.append("placeholder")
    flat = " ".join((t if t.isascii() else t.translate(_NOTHING)).split())
    low = flat.lower()
    hits = {kind for _, kinds_ in _FINDER.iter(low) for kind in kinds_}
    parts = [x.strip() for x in _BREAK.split(t)]
    if ("filler" in hits and _FILLER.search(flat)) or _hollow(low.split()) or any(a and a == b == c and not _FORMULA.search(a) for a, b, c in zip(parts, parts[1:], parts[2:])):
        out.append("filler")
    if ("request" in hits and _REQUEST.search(flat)) or "error" in hits and (_ERROR.search(flat) or any(len(x) < 90 and _MISSING.match(" ".join(x.split())) for x in parts)):
        out.append("error")
    if "script" in hits and _NAMED.search(low) and _NOTICE.search(flat):
        out.append("script")
    return out


_NOTHING = {0x200B: " ", 0xFEFF: " "}
# Formulas of the chair, which may be repeated.
_FORMULA = re.compile(r"\b(?:hear|oh|sitting|minutes|amendment|article|séance|procès-verbal|amendement|sitzung|protokoll|antrag|artikel|applause|laughter|applaudissements|beifall|heiterkeit|rires|sourires)\b", re.I)


def residue(documents: DataFrame) -> DataFrame:
    """doc_id and the kinds of residue of every document that holds any."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            k = [kinds(t) for t in p["text"]]
            hit = [bool(x) for x in k]
            yield pd.DataFrame({"doc_id": p["doc_id"][hit], "kinds": pd.Series([x for x in k if x], index=p.index[hit], dtype=object)})

    return documents.select("doc_id", "text").filter("text is not null and doc_id is not null").mapInPandas(run, "doc_id long, kinds array<string>")


def found(documents: DataFrame) -> DataFrame:
    return residue(documents).select("doc_id").distinct()


def report(documents: DataFrame) -> DataFrame:
    """Documents per language as stated and kind of residue."""
    r = residue(documents.select("doc_id", "text")).select("doc_id", F.explode("kinds").alias("kind"))
    return r.groupBy("kind").agg(F.count("*").alias("documents"))
