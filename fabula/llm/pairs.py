"""Defects of prompt and response pairs (problem 1).

The first that applies: empty, refusal (a grammar of declining sentences outside quoted speech), prompt_copy (greedy
string tiling with the rendered prompt), other_language (script and function words, sentence by sentence), truncated
(the end of the text, and a pushdown parser of fences, brackets, quotations, lists and markup). Whole texts are read;
cheap tests decide which texts need the costly ones.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.functions.text import render_prompt
from fabula.functions.words import split_words

DEFECTS = ("empty", "refusal", "prompt_copy", "other_language", "truncated")

# --- empty ---------------------------------------------------------------------------------------------------------

_LETTER = re.compile(r"[^\W_]")
_MARKER = re.compile(r"<\|[^<>]*\|>|</?[a-z_]{1,20}/?>|\[/?[A-Z_]{1,20}\]|[-*#=~_]{3,}", re.I)
# fixed values: labels and placeholders that are no answer
_LABELS = "story|summary|words|features|random sentence|sentence|answer|response|output|text|title|completion|assistant|user|prompt|geschichte|antwort|histoire|réponse|historia|cuento|respuesta"
_LABEL = re.compile(rf"(?:^|(?<=\n))\s*(?:{_LABELS})\s*:", re.I)
_PLACEHOLDER = {
    "", "n a", "na", "none", "null", "nil", "nan", "tbd", "tba", "todo", "empty", "blank", "placeholder", "no story", "no text", "no answer",
    "no response", "no output", "not available", "not applicable", "unknown", "undefined", "missing", "insert story here", "your story here",
    "story here", "story goes here", "text here", "lorem ipsum", "xxx", "x", "test", "eos", "bos", "pad", "unk", "endoftext", "end of text", "end", "the end", "story",
    "keine", "ninguno", "aucun",
}
_EMPTY_WORDS = {w for p in _PLACEHOLDER for w in p.split()} | set(re.findall(r"\w+", _LABELS))


def is_empty(story: str | None) -> bool:
    """Null, or nothing but white space, punctuation, markers, labels or a placeholder."""
    if story is None or not _LETTER.search(story):
        return True
    # a plain word that no placeholder, label or marker holds is left in the end
    if "<" not in story and "[" not in story and any(t.isascii() and t.isalpha() and t.lower() not in _EMPTY_WORDS for t in story.split()):
        return False
    rest = _MARKER.sub(" ", story)
    while (shorter := _LABEL.sub("\n", rest, count=1)) != rest:
        rest = shorter
    if not _LETTER.search(rest):
        return True
    words = split_words(rest)
    if set(words) <= {"n", "a", "na", "none", "null", "todo", "tbd"}:
        return True
    # one placeholder, or the same several times
    longest = max(len(p.split()) for p in _PLACEHOLDER)
    return any(" ".join(words[:n]) in _PLACEHOLDER and words == words[:n] * (len(words) // n) for n in range(1, min(longest, len(words)) + 1))


# --- quoted speech, sentences --------------------------------------------------------------------------------------

# speech that is still open where the text breaks off is a character's too
_QUOTED = re.compile(r"\"[^\"\n]*\"|(?:^|(?<=\s))[\"“„«][^\"”“»\n]*\Z|[“”][^“”\n]*”|„[^„“”\n]*[“”]|«[^«»\n]*»|‘[^‘’\n]*’(?=[\s,.;!?]|$)|(?:^|(?<=\s))'[^'\n]{2,}'(?=[\s,.;!?]|$)|^[ \t]*[—–][^\n]*", re.M)
_SENTENCE = re.compile(r"[^.!?…\n]+[.!?…]*")

# --- refusal -------------------------------------------------------------------------------------------------------

_OBJECT = r"(?:this|that|it|these|those|your|the|such|any|with|about|on|for|a|an|writing|story|text|request|prompt|task|content|topic|words)"
_WORK = r"(?:writ(?:e|ing)|creat(?:e|ing)|produc(?:e|ing)|generat(?:e|ing)|continu(?:e|ing)|complet(?:e|ing)|help(?:ing)?|assist(?:ing)?|provid(?:e|ing)|tell(?:ing)?|fulfil(?:l|ling)?|answer(?:ing)?|compos(?:e|ing)|finish(?:ing)?|respond(?:ing)?|comply(?:ing)?|proceed(?:ing)?|do(?:ing)?|mak(?:e|ing)|craft(?:ing)?|offer(?:ing)?|deliver(?:ing)?|go(?:ing)?|take|engag(?:e|ing)|work(?:ing)?)"
_NO = r"(?:can ?no?t|can't|could ?n[o']t|am unable to|'m unable to|am not able to|'m not able to|am not in a position to|will not|won't|would rather not|'d rather not|would prefer not to|'d prefer not to|must decline to|have to decline to|decline to|refuse to|must refuse to|am not allowed to|'m not allowed to|am not permitted to|do not wish to|don't wish to|don't want to|do not want to|am not going to|'m not going to|am not comfortable|'m not comfortable|shouldn't|should not|don't feel (?:able|comfortable))"
_THING = r"(?:story|text|tale|request|prompt|task|content|topic|theme|piece|words|instruction|writing|narrative|continuation|one|this|that|it)"
# each pattern with literals of which every text it matches holds one, looked for before the costly search
_REFUSALS = [
    (re.compile(p), tuple(h.split("|")))
    for p, h in (
        (rf"\b(?:i|we) ?{_NO}(?: \w+){{0,3}}? {_WORK} (?:\w+ ){{0,4}}?{_OBJECT}\b(?:.*\b{_THING}\b)?", "can't|cann|can n|couldn|could n|unable|not able|not in a position|will not|won't|rather not|prefer not|declin|refus|not allowed|not permitted|not wish|n't wish|n't want|not want|not going to|not comfortable|shouldn't|should not|don't feel"),
        (rf"\b(?:i|we) (?:must|have to|will have to|need to|'ll have to|am going to have to|would like to|respectfully|politely) ?(?:decline|pass on|refuse|say no to|turn down|skip|stop)\b", "declin|pass on|refus|say no to|turn down|skip|stop"),
        (rf"\b(?:i|we) (?:respectfully |politely )?(?:decline|refuse)\b.*\b{_THING}\b", "declin|refus"),
        (r"\b(?:is|was|be|would|will) not (?:be )?(?:right|appropriate|possible|suitable|proper|safe|okay|ok) for (?:me|us)\b", "for me|for us"),
        (r"\bisn't (?:right|appropriate|possible|suitable|proper|safe|okay|ok) for (?:me|us)\b", "for me|for us"),
        (r"\bnot (?:be )?(?:right|appropriate|suitable|possible) for (?:me|us) to (?:write|continue|create|tell|produce)\b", "for me|for us"),
        (r"\b(?:this|that|it) (?:isn't|is not) something (?:that )?(?:i|we)(?: can| will|'m| am|'ll)?\b", "n't something|not something"),
        (r"\bno (?:story|text|tale|answer|continuation) (?:will|can|may|shall) be (?:provided|written|given|told|created|produced|generated)\b", "no story|no text|no tale|no answer|no continuation"),
        (r"\bwriting (?:this|that|such a story|about (?:this|that)) (?:would|is|will) (?:not|n't) be\b|\bwriting (?:this|that|such a story) (?:would not|wouldn't|is not|isn't) (?:be )?\w+", "writing "),
        (r"\b(?:this|the|your|that) (?:request|prompt|topic|task|theme|content|story)\b.{0,40}\b(?:falls outside|goes against|violates|is against|is outside|is beyond|cannot be|can't be|may not be|is not (?:allowed|permitted|suitable|something|appropriate)|isn't (?:allowed|permitted|suitable|something|appropriate))", "outside|against|violates|beyond|cannot be|can't be|may not be|is not|isn't"),
        (r"\b(?:against|outside|beyond|under|violates?) (?:the rules|my rules|my guidelines|our guidelines|the guidelines|my policy|our policy|content policy|what i (?:do|can|am|may)|my (?:abilities|limits|scope))\b", "the rules|my rules|guidelines|policy|what i |my abilities|my limits|my scope"),
        (r"\b(?:let's|let us|please|could we|can we|shall we) (?:pick|choose|try|talk about|use) (?:something else|(?:a|an|some)?(?:other|another|different| ) ?(?:different |other )?(?:topic|theme|prompt|words|story))\b.*(?:not suitable|not right|not appropriate|instead|this one|can't|cannot)", "not suitable|not right|not appropriate|instead|this one|can't|cannot"),
        (r"\bas an? (?:ai|artificial|language model|assistant|writing assistant|automated|large language)\b", "as a ai|as an ai|artificial|language model|assistant|automated|large language"),
        (r"\b(?:stor(?:y|ies)|topics?|themes?|subjects?|requests?|prompts?|texts?|writing)\b.{0,40}\b(?:is|are|remains?|stays?) (?:strictly |simply |always )?(?:off[- ]limits|out of bounds|out of the question)\b", "off limits|off-limits|out of bounds|out of the question"),
        (r"\b(?:this|that|it|your|the)(?: \w+){0,2}? is (?:one|something|a (?:topic|theme|subject|story|request|prompt)) (?:that )?(?:i|we) (?:will|must|shall|would rather|have to|need to|prefer to|am going to) (?:leave|skip|pass|avoid|set aside|stay away|decline|steer clear)", "one i |one we |one that |something i |something we |something that |topic i |topic we |topic that |theme i |theme we |theme that |subject i |subject we |subject that |story i |story we |story that |request i |request we |request that |prompt i |prompt we |prompt that "),
        (rf"\b(?:i|we) (?:have to|must|will|shall|need to|would rather|prefer to|am going to) (?:leave|let) (?:this|that|your|the) {_THING}(?: \w+){{0,2}}? (?:unanswered|alone|aside|unwritten|untold|unfinished)\b", "leave this|leave that|leave your|leave the|let this|let that|let your|let the"),
        (r"^(?:please |kindly )?(?:try|pick|choose|send|give|offer|suggest)(?: me| us)? (?:a |an |some )?(?:different|another|new|other) (?:prompt|topic|theme|request|subject|idea)\b", "prompt|topic|theme|request|subject|idea"),
        (r"\b(?:non posso|non riesco a|non voglio|non potrò|mi dispiace|mi rifiuto di|preferisco non|devo rifiutare|non sono in grado di)\b.{0,60}(?:scrivere|aiutar|continuare|rispondere|raccontare|storia|racconto|testo|richiesta)", "non posso|non riesco|non voglio|non potrò|mi dispiace|mi rifiuto|preferisco non|devo rifiutare|non sono in grado"),
        (r"\b(?:não posso|não consigo|não vou|lamento|recuso-me a|prefiro não|devo recusar)\b.{0,60}(?:escrever|ajudar|continuar|responder|contar|história|conto|texto|pedido)", "não posso|não consigo|não vou|lamento|recuso-me|prefiro não|devo recusar"),
        (r"\bik (?:kan|mag|wil|zal|moet|ga)\b.{0,60}\b(?:niet|geen|weigeren|helaas)\b.{0,40}(?:schrijven|helpen|vertellen|voortzetten|verhaal|verzoek|tekst)", "niet|geen|weigeren|helaas"),
        (r"\bthere is no (?:text|story) to show\b|\bnot suitable for me\b", "no text|no story|not suitable"),
        (r"\bich (?:kann|darf|möchte|werde|muss)\b.{0,60}\b(?:nicht|ablehnen|leider)\b.{0,40}(?:schreiben|helfen|erfüllen|fortsetzen|erzählen|ablehnen|geschichte|anfrage|text|$)|\bkann ich (?:\w+ ){0,6}?(?:nicht|leider)\b.{0,40}(?:schreiben|helfen|erfüllen|fortsetzen|erzählen)", "nicht|ablehnen|leider"),
        (r"\bje (?:ne (?:peux|puis|veux) pas|regrette|refuse|dois refuser|suis désolée?|préfère ne pas)\b.{0,60}(?:écrire|aider|continuer|répondre|raconter|histoire|texte|demande)", "peux pas|puis pas|veux pas|regrette|refuse|suis désolé|préfère ne pas"),
        (r"\b(?:no puedo|no podré|lamento|me niego a|prefiero no|debo rechazar|no voy a)\b.{0,60}(?:escribir|ayudar|continuar|responder|contar|historia|cuento|texto|petición|solicitud)", "no puedo|no podré|lamento|me niego|prefiero no|debo rechazar|no voy a"),
    )
]
_HINTS = ahocorasick.Automaton()
for _hint in sorted({h for _, hints in _REFUSALS for h in hints}):
    _HINTS.add_word(_hint, tuple(i for i, (_, hints) in enumerate(_REFUSALS) if _hint in hints))
_HINTS.make_automaton()


def _hinted(text: str) -> set[int]:
    """The patterns of which the text holds a literal, found in one pass."""
    return {i for _, patterns in _HINTS.iter(text) for i in patterns}


def is_refusal(story: str) -> bool:
    """A sentence outside quoted speech declines, in the model's own voice, to write or continue."""
    own = _QUOTED.sub(" ", story)
    plain = own.lower() if own.isascii() else unicodedata.normalize("NFKC", own).replace("\u2019", "'").lower()
    if not _hinted(" ".join(plain.split())):
        return False
    for sentence in _SENTENCE.findall(plain):
        s = " ".join(sentence.replace("i'd rather", "i 'd rather").replace("i'm ", "i 'm ").replace("i'll", "i 'll").split())
        if any(_REFUSALS[i][0].search(s) for i in _hinted(s)):
            return True
    return False


# --- prompt copy ---------------------------------------------------------------------------------------------------


def _longest(text: list[str], source: list[str], free: list[bool], unused: list[bool], places: dict[tuple, list[int]], least: int) -> list[tuple[int, int, int]]:
    """(length, place in text, place in source) of all longest matches of free places with unused ones."""
    best, found = least, []
    for i in range(len(text) - least + 1):
        if not free[i]:
            continue
        for j in places.get(tuple(text[i : i + least]), ()):
            n = 0
            while i + n < len(text) and j + n < len(source) and free[i + n] and unused[j + n] and text[i + n] == source[j + n]:
                n += 1
            if n > best:
                best, found = n, []
            if n == best:
                found.append((n, i, j))
    return found


def _tiles(text: list[str], source: list[str], least: int, places: dict[tuple, list[int]]) -> list[bool]:
    """Again and again the longest matches of what is not marked yet are laid as tiles and marked on both sides. When
    none is left, the marks of source are taken off and its words may be used once more, so that repetitions are found."""
    free = [True] * len(text)
    while True:
        unused, laid = [True] * len(source), False
        while found := _longest(text, source, free, unused, places, least):
            for n, i, j in found:
                if all(free[i : i + n]) and all(unused[j : j + n]):
                    free[i : i + n] = [False] * n
                    unused[j : j + n] = [False] * n
                    laid = True
        if not laid:
            return [not f for f in free]


def tile(text: list[str], source: list[str], least: int = 3, span: int = 400) -> list[bool]:
    """Greedy string tiling: the words of text that lie in a tile, a run of at least `least` words that source holds; a
    short source counts from its own length on.

    A text is tiled in stretches of `span` words, or four times those of source, so that the work grows with its length
    only. A stretch begins where the tiles of the one before end.
    """
    least = max(1, min(least, len(source)))
    places: dict[tuple, list[int]] = {}
    for j in range(len(source) - least + 1):
        places.setdefault(tuple(source[j : j + least]), []).append(j)
    span, covered = max(span, 4 * len(source)), []
    while len(covered) < len(text):
        part = _tiles(text[len(covered) : len(covered) + span], source, least, places)
        if len(covered) + len(part) < len(text):
            open_end = next((k for k in range(least - 1) if part[-1 - k]), least - 1)
            part = part[: len(part) - open_end]
        covered += part
    return covered


def is_copy(words: list[str], prompt: Prompt, lead_in: int = 8, loose: float = 0.1) -> bool:
    """All words but a short lead-in and a few loose ones lie in tiles of the prompt."""
    inside = sum(map(prompt.known.__contains__, words))
    if not words or inside < 0.5 * len(words) or inside < len(words) - lead_in - loose * len(words):
        return False
    covered = tile(words, prompt.words)
    if True not in covered:
        # a prompt of one or two words, and nothing else, is a copy too
        return " ".join(words) in prompt.short
    first = covered.index(True)
    rest = covered[first:]
    return first <= lead_in and sum(rest) >= max(3, first) and (len(rest) - sum(rest)) <= max(1, loose * len(rest))


# --- language ------------------------------------------------------------------------------------------------------

# fixed values: frequent function words; words that two of the lists share are left out below
_FUNCTION_WORDS = {
    "en": "the and of to with was that for had they she his her he this from but not you said it were is are be been have there their them what when would which who how all into out up then than only could did your about my we me him its just like before after every never so as at on by nobody had some someone something very more kept felt went",
    "de": "der die das und nicht ein eine einen einem einer war den dem des mit sich auf ist als auch wie nach bei zu zum zur von im am aus wenn dass aber doch noch nur schon sehr wurde hatte er sie ich du wir ihr sein ihre denn weil bis niemand dort dann hinter neben unter alle wusste warum wollte",
    "fr": "en de la que un me te si a le les et une des est dans pas qui il elle avec pour sur du au ne ce cette ces son sa ses mais ou où car dit était avait été plus tout tous très leur nous vous je fut sont comme sans sous après pendant derrière quand jamais personne savait pourquoi là à",
    "es": "el los las y una no con por para su era se del al lo muy pero más como cuando sin sobre este esta estaba fue ya había porque donde en de que un me te si a les la nadie sabía qué él ella sus todo todos hace también entre hasta detrás allí aunque",
    "it": "la un a si il gli di che e una non con per era si del della dei delle nel nella ma più come quando sono suo sua loro anche questo questa aveva perché dove tutti molto",
    "pt": "que de a um me o os as e uma não com por para seu sua era se do da dos das no na mas mais como quando são também este esta tinha porque onde ele ela muito todos ao foi",
    "nl": "de het een en van niet met was dat voor zijn haar op is als ook naar bij maar nog hij zij ze er had werd toen want geen deze die wie hoe omdat",
}
_OF = {lang: frozenset(words.split()) for lang, words in _FUNCTION_WORDS.items()}
_OWNERS: dict[str, list[str]] = {}
for _lang, _list in _FUNCTION_WORDS.items():
    for _word in _list.split():
        _OWNERS.setdefault(_word, []).append(_lang)
_WORD_LANG = {w: o[0] for w, o in _OWNERS.items() if len(set(o)) == 1}
_SCRIPT = regex.compile(r"(?P<ru>\p{Cyrillic})|(?P<el>\p{Greek})|(?P<ar>\p{Arabic})|(?P<he>\p{Hebrew})|(?P<hi>\p{Devanagari})|(?P<ja>[\p{Hiragana}\p{Katakana}])|(?P<ko>\p{Hangul})|(?P<zh>\p{Han})|(?P<th>\p{Thai})")
_OTHER_SCRIPT = regex.compile(r"[\p{L}--\p{Latin}]", regex.V1)


def language(words: list[str]) -> str | None:
    """The language whose function words are most frequent, or whose script most of the words have; null if there are none."""
    hits = Counter(filter(None, map(_WORD_LANG.get, words)))
    text = " ".join(words)
    if not text.isascii() and _OTHER_SCRIPT.search(text):
        for m in _SCRIPT.finditer(text):
            hits[m.lastgroup] += 0.2
    return max(hits, key=lambda k: (hits[k], k == "en", k)) if hits else None


# the share of function words that a text of 8 words or more has at least, if it is in the language
_LEAST_SHARE = 0.05


def is_other_language(story: str, words: list[str], expected: str) -> bool:
    """Most of the words are in sentences of another language than the expected one, known or not: a text with next to
    none of its function words is not in it."""
    hits = Counter(filter(None, map(_WORD_LANG.get, words)))
    own = hits[expected]
    if len(words) >= 8 and expected in _OF and own < (least := _LEAST_SHARE * len(words)) and sum(map(_OF[expected].__contains__, words)) < least:
        return True
    if sum(hits.values()) <= 1.25 * own and own > 2 and (story.isascii() or not _OTHER_SCRIPT.search(story)):
        return False
    same = other = 0
    for sentence in _SENTENCE.findall(story):
        w = split_words(sentence)
        lang = language(w)
        if lang == expected:
            same += len(w)
        elif lang:
            other += len(w)
    return other > same


# --- truncation ----------------------------------------------------------------------------------------------------

_END = regex.compile(r"(?:[\p{So}\p{Sk}\p{Cf}\p{Z}\p{Cc}\p{Mn}*~_#=|•♥♡☆★]|[-–—]{2,}|<\|[^<>]*\|>|</?[a-z]{1,10}>)+$")
# fixed values: closing formulas
_CLOSING = re.compile(r"(?:(?<=[.!?…\"”»“’')\]])\s+|\s*\n\s*|^\s*)[\[(*_~\"“-]*\s*(?:the (?:very )?end|(?:and )?that(?: i|')s the end|end of (?:the )?story|finis|fin|ende|das ende|la fin|el fin|fim|fine|einde|(?:y )?colorín,? colorado,? este cuento se ha acabado|und wenn sie nicht gestorben sind,? (?:dann )?leben sie noch heute)\s*[\])*_~\"”-]*[.!…]*$", re.I)
_STOP = re.compile(r"[.!?…。！？][\])}\"”’'»“*_]*$")
_ABBREVIATION = re.compile(r"(?:^|[\s(\"“])(?:mr|mrs|ms|dr|st|prof|e\.g|i\.e|vs|z\.b|bzw|sr|sra|mme)\.$", re.I)
_LIST_MARK = re.compile(r"(?:^|\n)[ \t]*(?:\d{1,3}[.)]|[-*•+])[ \t]*$")
_ITEM = "item"
_MARK = r"(?:^|\n)[ \t]*(?:\d{1,3}[.)]|[-*•+])(?=\s|\Z)"
_LISTED = re.compile(_MARK)
_STRUCTURE = re.compile(r"```|[()\[\]{}\"“”„«»]|</?([a-zA-Z][a-zA-Z0-9]{0,10})[^<>]{0,80}>|\n\s*\n")
_WITH_LISTS = re.compile(f"{_MARK}|{_STRUCTURE.pattern}")
_QUOTES = ('"', "“", "„", "«", "»")
_PAIRS = {")": "(", "]": "[", "}": "{"}
# fixed values: tags that must be closed
_TAGS = set("a b i u em strong span div ul ol table h1 h2 h3 h4 code pre blockquote center".split())


def unclosed(text: str) -> bool:
    """A pushdown parser: something is still open at the end of the text.

    Fences, brackets and tags stay open until they are closed; quotations too, except that one left open in an earlier
    paragraph is taken for a stray mark. A list item is open until it has a word; what a new item finds open in the one
    before, but for fences and tags, ends with it. A closing mark without an opening one is passed over.
    """
    stack: list[str] = []
    began = 0
    for m in (_WITH_LISTS if _LISTED.search(text) else _STRUCTURE).finditer(text):
        mark = m[0]
        if stack and stack[-1] == _ITEM and _LETTER.search(text, began, m.start()):
            stack.pop()
        top = stack[-1] if stack else ""
        if top == "```":
            if mark == "```":
                stack.pop()
        elif mark == "```":
            stack.append(mark)
        elif mark.strip()[:1] in "-*•+0123456789" and mark.strip():
            while stack and stack[-1] in (_ITEM, *_QUOTES, *_PAIRS.values()):
                stack.pop()
            stack.append(_ITEM)
            began = m.end()
        elif mark[0] == "\n":
            while stack and stack[-1] in _QUOTES:
                stack.pop()
        elif mark[0] == "<":
            name = m[1].lower()
            if mark[1] == "/":
                if f"<{name}" in stack:
                    del stack[stack.index(f"<{name}") :]
            elif name in _TAGS and mark[-2] != "/":
                stack.append(f"<{name}")
        elif mark in "([{":
            stack.append(mark)
        elif mark in ")]}":
            if _PAIRS[mark] in stack:
                while stack.pop() != _PAIRS[mark]:
                    pass
        elif mark == '"':
            if '"' in stack:
                while stack.pop() != '"':
                    pass
            else:
                stack.append(mark)
        elif mark == "“":
            if top == "„":
                stack.pop()
            else:
                stack.append(mark)
        elif mark == "”":
            if top in ("“", "„") and top:
                stack.pop()
        elif mark == "„":
            stack.append(mark)
        elif mark == "«":
            if top == "»":
                stack.pop()
            else:
                stack.append(mark)
        elif mark == "»":
            if top == "«":
                stack.pop()
            elif top != "»":
                stack.append(mark)
    if stack and stack[-1] == _ITEM and _LETTER.search(text, began):
        stack.pop()
    return any(x != "»" for x in stack)


def _bare(text: str, step: int = 400) -> str:
    """The text without ornaments at its end, looked at from the end step by step."""
    while text:
        tail = text[-step:]
        m = _END.search(tail)
        if m is None:
            break
        text = text[: len(text) - len(tail) + m.start()]
        if m.start():
            break
    return text


def is_truncated(story: str) -> bool:
    """The text breaks off inside a sentence or a word, or inside a fence, a bracket, a quotation or a list item."""
    text = story.rstrip()
    if text[-1:] in '.!?"”' and _STOP.search(text[-8:]):
        body = text
    else:
        body = _bare(text)
        # a formula has fewer than 200 characters; what may follow it has any number
        while (shorter := _CLOSING.sub("", body[(cut := max(0, len(body.rstrip('])*_~"”-.!…')) - 200)) :])) != body[cut:]:
            body = _bare(body[:cut] + shorter)
        if not body:
            return False
        if not _STOP.search(body[-12:]):
            return True
    if _LIST_MARK.search(body[-12:]) or _ABBREVIATION.search(body[-12:]):
        return True
    return unclosed(text)


# --- pairs ---------------------------------------------------------------------------------------------------------


class Prompt:
    """What the tests need of a prompt."""

    def __init__(self, shown: str | None, summary: str | None, words: list | None, sentence: str | None):
        self.words = split_words(shown)
        self.known = set(self.words)
        own = split_words(" ".join([summary or "", sentence or ""]))
        self.language = language(own) or language(split_words(" ".join(x for x in words or [] if x))) or "en"
        self.short = {" ".join(split_words(x)) for x in [summary, sentence, *(words or [])] if x} - {""}


def defect(story: str | None, prompt: Prompt) -> str | None:
    """The first defect that applies, or null."""
    if is_empty(story):
        return "empty"
    if is_refusal(story):
        return "refusal"
    words = split_words(story)
    if is_copy(words, prompt):
        return "prompt_copy"
    if is_other_language(story, words, prompt.language):
        return "other_language"
    return "truncated" if is_truncated(story) else None


_OUT = "run_id string, id string, sample int, v timestamp, defect string"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    prompts: dict[str, Prompt] = {}
    seen: dict[tuple, str | None] = {}
    for batch in batches:
        get = {c: batch.column(c) for c in batch.schema.names}
        out = []
        ids, stories = get["id"].to_pylist(), get["story"].to_pylist()
        fields = None
        for i, (key, story) in enumerate(zip(ids, stories)):
            if (prompt := prompts.get(key)) is None:
                if fields is None:
                    fields = [get[c].to_pylist() for c in ("shown", "summary", "words", "sentence")]
                if len(prompts) >= 10_000:
                    prompts.clear()
                prompt = prompts[key] = Prompt(*(f[i] for f in fields))
            if story is not None and len(story) < 2000:
                if (key, story) not in seen:
                    if len(seen) >= 20_000:
                        seen.clear()
                    seen[key, story] = defect(story, prompt)
                out.append(seen[key, story])
            else:
                out.append(defect(story, prompt))
        yield pa.RecordBatch.from_arrays([get["run_id"], get["id"], get["sample"], get["v"], pa.array(out, pa.string())], names=["run_id", "id", "sample", "v", "defect"])


def judged_pairs(samples: DataFrame, prompts: DataFrame, small: int = 64_000_000, hot: int = 200_000) -> DataFrame:
    """run_id, id, sample, defect: one row per key of samples whose id has a prompt; defect is null for usable answers.

    Of rows with one key the last loaded counts (of equal ones the greatest defect); of several prompts with one id
    the greatest content. Keys with a null run_id or sample are keys like others; a null id has no prompt. Empty
    tables give no rows. small: characters of all prompts up to which they are broadcast; beyond it the join shuffles,
    and the samples of an id with more than `hot` of them are spread over several keys.
    """
    fields = ["summary", "words", "features", "sentence"]
    once = prompts.where("id is not null").groupBy("id").agg(F.max(F.struct(*fields)).alias("p")).select("id", *(F.col(f"p.{f}").alias(f) for f in fields))
    once = once.withColumn("shown", render_prompt())
    rows = samples.select("run_id", "id", "sample", "story", F.col("loaded_at").cast("timestamp").alias("v"))
    if (once.agg(F.sum(F.length("shown")).alias("n")).first().n or 0) <= small:
        both = rows.join(F.broadcast(once), "id")
    else:
        parts = rows.groupBy("id").agg(F.ceil(F.count("*") / hot).cast("int").alias("parts")).where("parts > 1")
        many = F.coalesce("parts", F.lit(1))
        salted = rows.join(parts, "id", "left").withColumn("salt", F.pmod(F.xxhash64("run_id", "sample"), many).cast("int")).drop("parts")
        wide = once.join(parts, "id", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), many - 1))).drop("parts")
        both = salted.join(wide, ["id", "salt"])
    judged = both.select("run_id", "id", "sample", "v", "story", *fields, "shown").mapInArrow(_judge, _OUT)
    last = judged.groupBy("run_id", "id", "sample").agg(F.max(F.struct("v", "defect")).alias("c"))
    return last.select("run_id", "id", "sample", F.col("c.defect").alias("defect"))
