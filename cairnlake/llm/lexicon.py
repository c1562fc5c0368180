"""Phrases by which error pages, script notices, filler and unfilled places are checked.

All of them are matched against wordings (lower case, single spaces), after quoted passages are taken out.
"""

from __future__ import annotations

import re

try:
    import ahocorasick
except ImportError:  # the pieces are then looked for one by one
    ahocorasick = None

# What servers and applications say instead of a page, in English, German, Spanish and French.
ERROR_PHRASES = (
    r"could not be found", r"\bnot found\b", r"no longer available", r"too many requests", r"unexpected end of response",
    r"handle \S+ is gone", r"try again later", r"we looked everywhere", r"leads nowhere", r"^0 results\b", r"nothing to see at this address",
    r"went wrong on our side", r"account has been suspended", r"session has expired", r"sign in again", r"is denied for your network",
    r"^access (?:to \S+ is )?denied", r"down for maintenance", r"^index of \S+ cannot be shown", r"did not answer in time", r"server \S+ (?:did|does|is) not (?:answer|respond)", r"^fatal\b",
    r"call to undefined", r"internal server error", r"service unavailable", r"bad gateway", r"^forbidden", r"traceback", r"^at \S+\.\S+ \(\S+:\d+\)",
    r"unhandled exception", r"page (?:you requested )?does not exist",
    r"wurde nicht gefunden", r"nicht gefunden werden", r"zugriff auf \S+ verweigert", r"zurzeit nicht erreichbar", r"wegen wartung",
    r"fehler aufgetreten", r"gibt es nicht mehr", r"sitzung ist abgelaufen", r"zu viele anfragen", r"server \S+ antwortet nicht", r"nicht mehr verfügbar",
    r"no se encontró", r"no se ha encontrado", r"error interno", r"acceso denegado", r"en mantenimiento", r"ya no está disponible",
    r"su sesión ha caducado", r"demasiadas solicitudes", r"servidor \S+ no responde",
    r"\bintrouvable", r"accès refusé", r"une erreur est survenue", r"en maintenance", r"n[’']est plus disponible", r"n[’']existe plus",
    r"session a expiré", r"trop de requêtes", r"serveur \S+ ne répond pas",
)
# Notices that scripts, a check or another browser is required.
SCRIPT_PHRASES = (
    r"javascript", r"needs scripts to run", r"active scripting", r"prove that you are not a robot", r"checking your browser",
    r"browser is too old", r"^loading(?: page)?\W*$", r"please wait while", r"cookies must be enabled", r"verify(?:ing)? (?:that )?you are (?:a )?human",
    r"ohne skripte", r"skripte (?:ein|aktiv)", r"browser wird geprüft", r"browser ist (?:zu alt|veraltet)", r"kein roboter", r"^(?:wird|seite wird) geladen",
    r"funciona con scripts", r"comprobando su navegador", r"navegador es (?:demasiado )?(?:viejo|antiguo)", r"no es un robot", r"active los scripts", r"^cargando",
    r"exécution de scripts", r"(?:vérification|contrôle) de votre navigateur", r"navigateur est trop (?:vieux|ancien)", r"pas un robot", r"^chargement",
)
# Texts that stand where an author was to write.
FILLER_PHRASES = (
    r"\bgoes here", r"sample paragraph", r"replace before (?:launch|publish)", r"placeholder for", r"^type something", r"add a description of your",
    r"edit this block", r"^todo\b", r"lorem ipsum", r"dummy text", r"your (?:text|title|heading) here", r"click here to (?:edit|add)", r"^untitled$",
    r"blindtext", r"mustertext", r"hier eingeben", r"bitte ersetzen", r"hier steht (?:ihr|dein|der) text", r"platzhalter",
    r"aquí va su", r"escriba un título", r"párrafo de muestra", r"texto de (?:relleno|muestra|ejemplo)", r"sustituir antes de",
    r"texte (?:provisoire|d[’']exemple)", r"d[’']exemple, à remplacer", r"remplacer avant", r"votre texte", r"saisissez (?:un|votre) titre", r"titre ici",
)
# The words of the customary pseudo-Latin and the endings of its imitations.
PSEUDO_LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim "
    "veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse "
    "cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
PSEUDO_LATIN_ENDINGS = ("amet", "ectus", "ulum", "ibus", "isque", "andit", "etur", "iores", "ipsa")
# The signs by which template languages mark a place to fill.
PLACE = re.compile(
    r"\{\{.*?\}\}|\{%.*?%\}|<%.*?%>|[$#]\{[^{}]*\}|\{\$?[a-z_][\w.\[\]]*\}|%%[\w.\[\]]+?%%|%[a-z_][\w.\[\]]*%|__[a-z][\w.\[\]]*?__|<<[\w.\[\]]+>>"
    r"|\[\[[\w.\[\]]*?\]\]|\[insert [^\]]*\]\]?|\[[a-z]+_[a-z_]+\]|\[(?:company|headline|subtitle|body|count|price|date|name|title|email|address)\]"
    r"|\$[a-z_][\w.\[\]]*\$|@@[\w.\[\]]+@@"
)

_SIGN = re.compile(r"[{<%_\[$@#]")
STATUS = re.compile(r"^(?:(?:error|fehler|erreur)\s*)?[45]\d\d(?:\b.{0,24})?$|^(?:oops|ups|hoppla|oups|error|fehler|erreur)\W*$")
_QUOTE = re.compile(r"[“„«\"]")
_QUOTED = re.compile(r"“[^“”]*”|„[^„“”]*[“”]|«[^«»]*»|\"[^\"]*\"")
_WORD = re.compile(r"[^\W\d_]+")


def literals(pattern: str) -> tuple[str, ...]:
    """The plain pieces that every match of a pattern holds: what is left without groups, classes and optional characters."""
    while True:
        bare = re.sub(r"\((?:[^()\\]|\\.)*\)[?*+]?", "\0", pattern)
        if bare == pattern:
            break
        pattern = bare
    bare = re.sub(r"\[[^\]]*\][?*+]?|\\[A-Za-z][?*+]?|\\?.[?*]|[\^$+]|\\.", "\0", pattern)
    return tuple(x for x in sorted(bare.split("\0"), key=len, reverse=True) if x.strip())


_PHRASES = [(literals(p)[0], re.compile(p)) for p in ERROR_PHRASES + SCRIPT_PHRASES + FILLER_PHRASES]


def _finder():
    """Text to the numbers of the phrases whose longest plain piece stands in it."""
    if ahocorasick is None:
        return lambda text: [i for i, (piece, _) in enumerate(_PHRASES) if piece in text]
    at: dict[str, list[int]] = {}
    for i, (piece, _) in enumerate(_PHRASES):
        at.setdefault(piece, []).append(i)
    automaton = ahocorasick.Automaton()
    for piece, numbers in at.items():
        automaton.add_word(piece, numbers)
    automaton.make_automaton()
    return lambda text: {i for _, numbers in automaton.iter(text) for i in numbers}


_FOUND = _finder()


def holds_place(wording: str) -> bool:
    """Whether an unfilled place stands in the wording."""
    return bool(_SIGN.search(wording) and PLACE.search(wording))


def unquoted(wording: str) -> str:
    """The wording without its quoted passages."""
    return _QUOTED.sub(" ", wording) if _QUOTE.search(wording) else wording


def is_drone(wording: str) -> bool:
    """One to three words over and over, or mostly pseudo-Latin."""
    words = _WORD.findall(wording)
    if len(words) >= 2 and len(set(words)) == 1 or len(words) >= 8 and len(set(words)) <= 2 and wording.count(",") == 0:
        return True
    # Mostly: seven words in ten, so that more than three in ten others settle it.
    others = 0
    for w in words:
        if w not in PSEUDO_LATIN and not w.endswith(PSEUDO_LATIN_ENDINGS):
            others += 1
            if others > 0.3 * len(words):
                return False
    return len(words) >= 4


def says_nothing(wording: str) -> bool:
    """An error, a script notice or filler, and nothing quoted from one."""
    own = unquoted(wording)
    if any(_PHRASES[i][1].search(own) for i in _FOUND(own)):
        return True
    return bool(STATUS.match(own) or is_drone(own))
