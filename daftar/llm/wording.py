"""Wording shared by the operators on answers: clauses, languages, refusals, placeholders."""

from __future__ import annotations

import re
from functools import lru_cache

from daftar.llm.lookalike import canonical
from daftar.llm.overlap import words

# --- fixed values -------------------------------------------------------------------------------
PLACEHOLDERS = frozenset("null none nan nil n/a na n.a. empty undefined لا يوجد [] {} - -- … ... «» \"\" '' tbd todo".split()) - {"لا", "يوجد"} | {"لا يوجد", "no answer", "no response"}
YES_NO = frozenset("نعم لا بلى أجل كلا yes no oui non si sí".split())
#: Declining in the speaker's own name.
REFUSAL = re.compile(
    r"لا أستطيع|لا استطيع|لم أستطع|لن أستطيع|لا يمكنني|لا يمكننا|لن يمكنني|لا أقدر|لست قادر|غير قادر على (?:الإجابة|الرد|المساعدة)|يتعذر علي|ليس (?:لدي|بإمكاني|بوسعي)|ليست لدي|لا أملك|لا أمتلك|لم أجد|لا أجد|لم أتمكن|لا أتمكن"
    r"|لا (?:تتضمن|تحتوي|توجد|يوجد)[^.]{0,30}(?:جواب|إجابة)|أنا مجرد|لا أقدم|أعتذر عن|أفضل عدم"
    r"|\b(?:i|we)(?:'m| am| are|'re)? (?:really )?(?:sorry|afraid|unable|not able|not in a position|can'?t|cannot|can not|could not|couldn'?t|won'?t|do not have|don'?t have|don'?t know|must decline|am only|only an)\b"
    r"|\bi'?m (?:only|just|not|unable|sorry|afraid)\b|\bthere (?:isn'?t|is not) enough\b|\bnothing in the (?:supplied|given|provided|available)\b|\bnot enough information\b|\bdon'?t give (?:legal|any)\b|\bas an? (?:ai|assistant|language model)\b"
    r"|je (?:ne )?(?:peux|puis|suis|dispose|trouve|saurais|sais)[^.]{0,12} pas|ne (?:me|nous) permett\w+ pas|je ne suis qu|je regrette|pas en mesure"
    r"|no puedo|no podemos|no me es posible|no tengo (?:suficiente|informaci)|no dispongo|no encuentro|no estoy en condiciones|los textos[^.]{0,30} no (?:me )?permiten|solo soy|no doy",
    re.IGNORECASE,
)
#: What goes along with declining but says nothing alone.
APOLOGY = re.compile(
    r"^(?:آسف|عذرا|نعتذر|أعتذر|للأسف|معذرة|sorry|unfortunately|i apologi[sz]e|my apologies|désolée?|malheureusement|je regrette|lo siento|lamentablemente|por desgracia)\b"
    r"|يرجى مراجعة|جرب صياغة|try rephras|qualified adviser|consultez un|consulte a un|reformul",
    re.IGNORECASE,
)
STOPWORDS = {
    "en": frozenset("the of and to in is within on for by at if with named article must shall may which that what how does do under when once".split()),
    "fr": frozenset("le la les l de des du d un une et en à au dans par pour sur est que qui ne pas si avec après selon délai visé quels".split()),
    "es": frozenset("el los las un una del y en con por para su es que no se al si días artículo plazo según sin cuando lo".split()),
    "de": frozenset("der die das und ist nicht ein eine einen dem den des zu mit von für auf im wird werden innerhalb nach oder wenn".split()),
    "it": frozenset("il lo gli della dello degli che di è un una per con sono nel alla entro deve dopo se questo".split()),
    "pt": frozenset("o os as da do das dos que não um uma em no na para com são deve após prazo se pelo ao".split()),
    "nl": frozenset("de het een van en is niet dat op te met voor binnen moet worden zijn wordt door aan als".split()),
    "tr": frozenset("ve bir bu için ile olarak içinde göre değil olan gibi veya tarafından sonra daha ne gün".split()),
    "pl": frozenset("w i na nie jest się do że z od przez lub oraz dla być po ciągu dni musi".split()),
    "sv": frozenset("och att det som en ett är inte av för med på till inom ska efter om den dagar".split()),
    "id": frozenset("yang dan di untuk dengan tidak dari dalam ini itu pada adalah harus atau oleh hari setelah".split()),
}
#: Words of declining, in three parts that a refusal has together in whatever wording: no or a bound, speaking or knowing, oneself or the matter.
DECLINING = {
    "bound": frozenset(
        "cannot can't cant unable not outside beyond decline declining refuse prefer rather refrain avoid lack insufficient unfortunately don't won't couldn't no never without "
        "ne pas préfère refuse hors dépasse incapable impossible abstiens sans aucun aucune jamais "
        "no prefiero rehúso fuera excede incapaz imposible abstengo sin ningún ninguna "
        "لا لم لن ليس ليست لست خارج تتجاوز يتجاوز أفضل أمتنع عدم غير يتعذر يصعب تنقصني أعجز دون".split()
    ),
    "speech": frozenset(
        "answer answers answering help helping assist assistance respond reply discuss comment advise advice guidance opinion opinions question questions request topic subject matter information knowledge scope purview expertise remit know weigh "
        "répondre réponse aider aide assister commenter conseiller avis conseil question demande sujet connaissances connaissance informations domaine compétence compétences savoir "
        "responder respuesta ayudar ayuda ayudarle comentar aconsejar opinión opinar consejo pregunta solicitud tema conocimiento conocimientos información ámbito competencia "
        "أجيب الإجابة إجابة الرد أرد المساعدة أساعد مساعدتك رأي رأيا مشورة السؤال سؤالك طلبك الموضوع معرفتي معلومات معلوماتي نطاق اختصاصي قدرتي إمكاني علمي تخصصي أعلم أعرف".split()
    ),
    "self": frozenset(
        "i i'm i'd i've me my we us our this that it je j me m mon ma mes nous cela ça ceci cette ce yo mi mis nos nosotros me eso esto esta este "
        "أنا نحن هذا هذه ذلك معرفتي معلوماتي اختصاصي قدرتي علمي تخصصي بوسعي بإمكاني لدي عندي أجيب أساعد أرد أفضل أمتنع سؤالك طلبك".split()
    ),
}
# ------------------------------------------------------------------------------------------------
QUOTED = re.compile(r"«[^»]*»|\"[^\"]*\"|“[^”]*”")
CITATION = re.compile(r"\(?\[\s*(?:مادة|المادة|articles?|art\.?|artículo)\s*[\d٠-٩]+\s*\]\)?", re.IGNORECASE)
_CLAUSE = re.compile(r"(?<=[.!?؟؛:])[\s\"»”)\]]*\s+|\n+")
_ARABIC = re.compile(r"[ؠ-يٮ-ۓ]")
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]")
_TOKEN = re.compile(r"[^\W\d_]+")
_SPOKEN = re.compile(r"[^\W\d_]+(?:['’]t|['’](?:m|d|ve)\b)?")
_BLANK = re.compile(r"[\W_]+")


def is_empty(text: str | None) -> bool:
    """Null, or nothing but blanks, signs or a placeholder."""
    if not text:
        return True
    bare = canonical(text).strip().casefold()
    return bare.strip(" .!") in PLACEHOLDERS or bare in PLACEHOLDERS or not _BLANK.sub("", bare)


def clauses(text: str) -> list[str]:
    """Sentences of an answer; a citation behind a full stop stays with its sentence."""
    out: list[str] = []
    for part in _CLAUSE.split(text):
        part = part.strip()
        if not part:
            continue
        if out and not _TOKEN.search(CITATION.sub("", part)):
            out[-1] += " " + part
        else:
            out.append(part)
    return out


_SCRIPTS = {
    "cyrillic": "Ѐ-ӿ", "greek": "Ͱ-Ͽἀ-῿", "hebrew": "א-ת", "armenian": "Ա-֏", "devanagari": "ऀ-ॿ", "thai": "ก-๛", "hangul": "가-힣ᄀ-ᇿ", "kana": "ぁ-ヿ", "han": "㐀-䶿一-鿿",
}
_OTHER_SCRIPT = re.compile("[" + "".join(_SCRIPTS.values()) + "]")
_OF_SCRIPT = {name: re.compile(f"[{chars}]") for name, chars in _SCRIPTS.items()}
#: Characters of a script written without spaces that make a word.
_WORD_SIGNS = {"han": 2, "kana": 3, "thai": 5}


@lru_cache(maxsize=20_000)
def language(text: str) -> tuple[str | None, int]:
    """(main language or script, words that tell it); ``latin`` is a language in Latin letters that no function word gives away."""
    text = CITATION.sub(" ", canonical(text))
    tokens = _TOKEN.findall(text)
    if _OTHER_SCRIPT.search(text):
        # letters that look like Latin ones are Latin now, so a word is of the script that any of its letters is still of
        size: dict[str, int] = {}
        count: dict[str, int] = {}
        for w in tokens:
            kind = next((n for n, p in _OF_SCRIPT.items() if p.search(w)), "arabic" if _ARABIC.search(w) else "latin")
            size[kind] = size.get(kind, 0) + len(w)
            count[kind] = count.get(kind, 0) + max(1, len(w) // _WORD_SIGNS.get(kind, len(w)))
        main = max(sorted(size), key=lambda k: size[k])
        if main in _OF_SCRIPT:
            # Japanese has both kinds of signs
            return "kana" if main == "han" and "kana" in size else main, count[main]
    arabic, latin = len(_ARABIC.findall(text)), len(_LATIN.findall(text))
    if arabic + latin == 0:
        return None, 0
    if arabic >= latin:
        return "ar", len(tokens)
    tokens = [w.lower() for w in tokens]
    votes = {k: sum(w in s for w in tokens) for k, s in STOPWORDS.items()}
    best = max(sorted(votes), key=lambda k: votes[k])
    return (best if votes[best] else "latin"), len(tokens)


def is_yes_or_no(text: str) -> bool:
    return text.strip(" .،,!?؟\"'").casefold() in YES_NO


def other_language(a: str | None, b: str | None) -> bool:
    """Whether two main languages are known to differ."""
    if not a or not b or a == b:
        return False
    return "latin" not in (a, b) or not {a, b} <= {"latin", *STOPWORDS}


@lru_cache(maxsize=20_000)
def declining(clause: str) -> tuple[bool, bool, bool]:
    """Which parts of declining a clause has: a bound, speech or knowledge, oneself or the matter; quotations are not the speaker's."""
    own = set(_SPOKEN.findall(QUOTED.sub(" ", canonical(clause)).lower()))
    return tuple(bool(own & words) for words in DECLINING.values())


@lru_cache(maxsize=20_000)
def is_refusal(clause: str) -> bool:
    """Whether a clause declines; words inside quotation marks are not the speaker's."""
    return bool(REFUSAL.search(QUOTED.sub(" ", canonical(clause))))


@lru_cache(maxsize=20_000)
def bag(text: str) -> tuple[str, ...]:
    """Folded words of a clause or question; questions come again and again."""
    return tuple(words(text))
