"""Which of the corpus' languages a text is in, by function words and script."""

from __future__ import annotations

import re
import unicodedata

#: Frequent function words of each language; fixed values.
FUNCTION_WORDS = {
    "en": "a the and of to is in you that it for are with as at be this have from or by not but what can could would will your we us they their there here if me my do does did which how when where i he she was were has had an on so than then after before around all any some please thanks yes no might shall should am its our one about out up more most need want like great perfect good sounds right fine sure hello hi lovely wonderful indeed when because since every just outside never always while under behind although once",
    "de": "der die das und ist in zu den dem des ein eine einen einem einer nicht mit auf für von sich auch es an werden aus er hat dass sie nach wird bei um am sind noch wie über zum zur haben nur oder aber vor bis mehr durch man sein wurde wir ich ihr ihre ihren ihnen uns kann können könnten möchten soll gibt dann gern gerne ja nein bitte danke vielen guten tag leider etwas uhr wenn habe mich meine mein wann wo dort hier",
    "fr": "le la les des et est une un du de que qui dans pour pas sur au aux avec ce cette ces il elle nous vous ils je ne se son sa ses mais ou où par plus même sont être avoir votre vos mon ma mes leur leurs chez donc alors bien merci bonjour oui non très encore aussi y en à été avez pourrait voulez reste celle depuis jusqu",
    "it": "il lo gli le un una di da in su per con non è che sono si la dal della del al alla ci c'è ma anche come più molto quando dove questo questa vostro vostra suo sua vicino fiume purtroppo altra circa ho ha hai abbiamo buongiorno grazie prenotazione numero inizia rimasto posto dalle vogliono soluzione completo vuole",
    "pt": "o os as um uma de do da dos das em no na nos nas por para com não que é são se ao à mais mas também como muito quando onde este esta seu sua você perto rio longe ainda há lugar começa número reserva infelizmente outra cerca tem obrigado bom dia às fica até quer partir",
    "nl": "de het een van in op voor met niet dat is zijn te aan er om ook als maar nog naar bij uit over wij u uw heeft begint uur ligt aan helaas andere ongeveer geen wel vol dichtbij dank goedendag graag kunt reservering boeking",
    "pl": "i w z na do nie się jest to że od za po jak ale przez dla są czy ma pan pani państwo około niestety inna możliwość numer rezerwacja zaczyna nad niedaleko dom stoi rzeką wolnych miejsc jeszcze dziękuję dzień dobry proszę o minut tramwajem",
    "sv": "och i att det som en ett på är av för med den till inte om har från men jag vi ni du er ditt din vid tyvärr annan cirka ligger nära ännu plats klockan börjar nummer tack god dag kan vill",
    "da": "og i at det som en et på er af for med den til ikke om har fra men jeg vi du jeres din ved desværre anden cirka ligger nær endnu plads klokken begynder nummer tak god dag kan vil",
    "tr": "ve bir bu da de için ile ne var yok çok daha gibi ama olan olarak mı mi en az kadar sonra önce saat numara yakın maalesef başka yaklaşık rezervasyon ev nehir teşekkürler günaydın lütfen",
    "es": "el la los las de que y en un una por con no es para al lo del se su sus como más pero o este esta hay muy sin sobre también me ya le les nos usted ustedes quiere gracias buenos días sí mi desde hasta cuando donde qué son está están tiene puede podría entonces bien antes tarde mañana a otra otro cerca gusto buen viaje lleno casa río junto lejos reservar",
}
_OF: dict[str, set[str]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in _words.split():
        _OF.setdefault(_w, set()).add(_lang)
#: Letters that point to one language.
_MARKS = {"ã": "pt", "õ": "pt", "ł": "pl", "ą": "pl", "ę": "pl", "ż": "pl", "ź": "pl", "ś": "pl", "ć": "pl", "å": "sv", "ø": "da", "æ": "da", "ı": "tr", "ğ": "tr", "ş": "tr", "ß": "de", "ä": "de", "ö": "de", "ñ": "es", "¿": "es", "¡": "es", "ê": "fr", "ç": "fr", "œ": "fr", "è": "fr", "à": "fr", "ù": "fr", "î": "fr", "ó": "es", "í": "es"}
_WORD = re.compile(r"[^\W\d_]+")


def scripts(text: str) -> str:
    """The script most letters of the text belong to, by the first word of their Unicode names."""
    seen: dict[str, int] = {}
    for c in text:
        if c.isalpha():
            s = "LATIN" if c < "ɐ" else unicodedata.name(c, "?").split()[0]
            seen[s] = seen.get(s, 0) + 1
    return max(seen, key=seen.get) if seen else ""


def language(text: str | None) -> tuple[str, float]:
    """(language, evidence): the best language and by how much weighted words it leads.

    Words shared by several languages count for each by an equal part. A text
    in a script other than Latin has that script's name as its language. No
    evidence gives ``("", 0)``.
    """
    if not text:
        return "", 0.0
    if not text.isascii():
        script = scripts(text)
        if script and script != "LATIN":
            return script, float(len(text))
    score: dict[str, float] = {}
    for w in _WORD.findall(text.lower()):
        for lang in (langs := _OF.get(w, ())):
            score[lang] = score.get(lang, 0.0) + 1.0 / len(langs)
    if not text.isascii():
        for c, lang in _MARKS.items():
            if c in text:
                score[lang] = score.get(lang, 0.0) + 0.5
    if not score:
        return "", 0.0
    first, *rest = sorted(score.items(), key=lambda x: (-x[1], x[0]))
    return first[0], first[1] - (rest[0][1] if rest else 0.0)
