"""Broken prompt and response pairs.

Each answer is read with the prompt it was given to and gets the one defect it has, tested in this order:

- `empty`: no letter or digit.
- `refusal`: an automaton over phrases finds, outside quotations, one in which somebody declines; or one in which somebody
  is unable or unwilling, soon followed by a verb of answering; or parts that do so together in one sentence. Being unable
  to do other things, not knowing a detail or speaking of guidelines is no refusal.
- `copy`: the answer's words run through the suffix automaton of the prompt; stretches of `COPY_RUN` words or more count
  as copied. The answer copies if nearly all of the prompt is given back and what is not copied only frames it.
- `language`: the votes of stopwords, or the script, name another language for the answer than for the prompt.
- `truncated`: a stack of delimiters ends inside a code block; or the text ends at a mark that cannot end one; or its last
  sentence or item has no end although the ones before it have; or it is one long stretch without an end. Short phrases
  and items standing by themselves are complete.

Plan: the runs are joined to the prompts on their id (Catalyst broadcasts the prompts where they are small and splits a
hot id where they are not), classified in Arrow batches, and only defective runs are reduced to one row per run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlake.llm.leaks import Automaton, words_of

COPY_RUN = 3
COPY_SHARE = 0.85
FRAME_WORDS = 6
PHRASE_WORDS = 8
KEEP = 4096

#: Function words of the languages told apart.
STOPWORDS = {
    "en": "the of and is are was were to with for that this by at from which it its be has have not as or an on when while if so here before after into every each unless within whenever although though below near they them there",
    "de": "der die das und ist sind den dem des von für mit nach auf ein eine einer nicht sobald obwohl während bei als im zu wird was dass oder hier laut gilt wenn wie über aus",
    "fr": "le la les des du de et est une un pour dans sur que qui pas au aux après même ce cette dès pendant d’après selon quand ou par ne se encore sont avec en",
    "es": "el la los las de y es en por para con que una un del según más aunque tras durante lo cuando cada se su al no sin esta este",
    "pt": "o os as do da dos e é em não uma um com para por que embora após ao à de mais na no quando se pelo pela",
    "it": "il lo gli le di e è con che una un del della dei non dopo anche sono al nel alla da quando questo",
    "nl": "het een van voor met na op niet als bij te wordt dat die zijn uit wanneer ook naar",
}
_VOTES: dict[str, list[str]] = {}
for _language, _words in STOPWORDS.items():
    for _w in _words.split():
        _VOTES.setdefault(_w, []).append(_language)

#: Endings of lower-case words that speak for a language.
ENDINGS = {"ador": "es pt", "ção": "pt", "ções": "pt", "ão": "pt", "ción": "es", "ciones": "es", "miento": "es", "ung": "de", "keit": "de", "lich": "de", "isch": "de", "ement": "fr", "ées": "fr", "ée": "fr", "euse": "fr", "zione": "it", "zioni": "it", "heid": "nl", "ing": "en", "ness": "en"}
#: Letters that speak for a language in lower-case words.
LETTERS = {"ñ": "es", "ú": "es pt", "í": "es pt", "ó": "es pt", "á": "es pt", "ã": "pt", "õ": "pt", "ä": "de", "ö": "de", "ü": "de", "ß": "de", "è": "fr it", "ê": "fr pt", "û": "fr", "ô": "fr pt"}
#: Votes that a language needs, and by which it has to lead the prompt's.
LEAST, LEAD = 1.2, 1.2

#: Fixed values, words parted by one blank and without punctuation, a full stop for the end of a sentence. Phrases that
#: decline by themselves.
DECLINING = """
i refuse to; i decline to; i must decline; i must refuse; i have to refuse; i give no answers; i give no answer; i do not comment; i don t comment; i have no answer; i do not know .; i don t know .; i do not know the answer; i don t know the answer; let s talk about something other than; let s talk about something else; let us talk about something other than; let us talk about something else; . no comment .
ich muss ablehnen; ich lehne ab; ich weiß es nicht .; . kein kommentar .; reden wir lieber; sprechen wir lieber
je dois refuser; je dois décliner; je refuse de; je décline; je ne réponds pas; je ne sais pas .; . pas de commentaire .; . sans commentaire .; . aucun commentaire .; parlons d autre chose; parlons plutôt
debo rechazar; debo negarme; debo declinar; me niego a; no lo sé .; . sin comentarios .; hablemos de otra cosa; hablemos mejor
devo recusar; recuso me; não sei .; . sem comentários .
devo rifiutare; devo rifiutarmi; devo declinare; mi rifiuto; non lo so .; . nessun commento .
ik moet weigeren; ik weiger; ik weet het niet .; . geen commentaar .
вынужден отказаться; вынуждена отказаться; отказываюсь отвечать; я не знаю .
"""
#: Phrases in which a speaker is unable or unwilling; a verb of answering has to follow soon.
UNABLE = """
i cannot; i can t; i can not; i am unable to; i m unable to; i am not able to; i m not able to; i was not able to; not in a position to; i must refrain; i have to refrain; i have to decline; i won t; i will not; i would rather not; i d rather not; i prefer not to; i would prefer not to; i do not; i don t; i may not; i am not allowed to; i m not allowed to; not possible for me; impossible for me
kann ich nicht; ich kann nicht; ich kann leider nicht; ich bin nicht in der lage; bin ich nicht in der lage; darf ich nicht; ich darf nicht
je ne peux; je ne puis; je ne suis pas; je ne souhaite; je ne veux; je ne dois; je préfère ne; m est impossible; m est pas possible; m est interdit
no puedo; no podré; prefiero no; no me es posible; me es imposible; me resulta imposible; no estoy en condiciones; no soy capaz; no estoy autorizado
não posso; não consigo; prefiro não; não me é possível; é me impossível; não estou em condições
non posso; non riesco a; non sono in grado; non mi è possibile; mi è impossibile; preferisco non; non sono autorizzato
я не могу; не могу
"""
#: What states a bar to answering; a word of answering has to stand in the same sentence.
BARRED = "outside of what i am; outside of what i can; outside of what i may; beyond what i am; beyond what i can; beyond what i may; my guidelines rule out; my guidelines forbid; my guidelines prevent; my guidelines do not; my guidelines don t; my instructions rule out; my instructions forbid; my instructions prevent; my instructions do not; my instructions don t; no comment"
#: Verbs and nouns of answering, and what stands for them.
ANSWERING = """
help; assist; answer; respond; reply; discuss; say; provide; give; comment; talk; speak; share; disclose; offer; tell; comply; fulfil; fulfill; do; answering; responding; replying; discussing; commenting; helping; from my side; from me; ask somebody else; ask someone else
beantworten; antworten; sagen; helfen; sprechen; geben; mitteilen; antwort; auskunft; anfrage; bitte; frage
répondre; parler; dire; donner; aider; discuter; fournir; commenter; partager; traiter
responder; hablar; decir; dar; ayudar; ayudarte; ayudarle; proporcionar; facilitar; comentar; contestar; compartir; discutir
falar; dizer; ajudar; fornecer; partilhar
rispondere; parlare; dire; dare; aiutare; aiutarti; aiutarla; fornire; commentare; discutere
ответить; отвечать; помочь; сказать; говорить; обсуждать; предоставить; дать ответ; прокомментировать
"""
#: One of the first and one of the second have to stand in one sentence; or one of the first, one of the
#: third and a word of answering.
SPEAKERS = "i; i m; i d; i ll; ich; mir; mich; je; j; yo; eu; io; ik; mij; мне; я"
DENIALS = "not answer; not discuss; not comment; not reply; not respond; nothing to say; nichts sagen; nicht beantworten; nicht antworten; nicht helfen; nicht sagen; nicht sprechen; keine antwort; keine auskunft; niet beantwoorden; niet antwoorden; niet helpen; niet zeggen; niets zeggen; niet bespreken; geen antwoord; geen commentaar"
LACKS = "refrain; decline; refuse; ablehnen; verweigern; nicht möglich; refuser; refusé; отказ"
#: Declining phrases of scripts written without blanks.
UNPARTED = "お答えできません；お答えすることはできません；回答できません；回答することはできません；答えられません；答えることはできません；お手伝いできません；お手伝いすることはできません；お答えいたしかねます；お答えしかねます；回答を控え；回答は控え；わかりません。；分かりません。；无法回答；不能回答；不便回答；拒绝回答；无法提供；无法帮助；不能提供；我不知道。；无法讨论；不能讨论".split("；")
#: Characters that may lie between a phrase of UNABLE and the verb.
SOON = 30

#: Words that only frame a question that is given back.
FRAME = set("question q the is was you asked me your prompt user frage die lautet sie fragten la pregunta es usted preguntó le votre vous avez demandé pergunta a o here again repeat answer réponse antwort respuesta".split())
#: Words that a sentence does not end with.
OPEN_WORDS = set("the a an of and or to in on at by for with from that which is are was than each every der die das und oder von für mit ein eine den dem des im zu le la les de des du et ou un une pour dans sur que qui el los las y en por para con del o os as do da em um uma".split())

_QUOTED = re.compile(r"“[^”]*”|„[^“”]*[“”]|«[^»]*»|\"[^\"\n]*\"|「[^」]*」")
_PLAIN = re.compile(r"[^\w.!?。！？\n]+|_")
_SENTENCES = re.compile(r"[.!?。！？\n]+")
_TERMINAL = ".!?。！？…"
_ITEM = re.compile(r"\s*(?:[-*•+]|(\d+)[.)])\s+\S")
_INNER_END = re.compile(r"[.!?][\"”’')\]]*\s+\S|[。！？]")
_UNBLANKED = re.compile("[\u3040-\u9fff]")
_HAN = re.compile("[一-鿿]")
_CYRILLIC = re.compile("[Ѐ-ӿ]")
_LETTERS = re.compile(r"[^\W\d_]+(?:’[^\W\d_]+)?")
_ANY_WORD = re.compile(r"\w")
_SIGN = re.compile(r"[^\W_]")
_DELIMITERS = re.compile(r"^[ \t]*(?:```|~~~)|[()\[\]{}“”«»]", re.M)
_CLOSERS = "\"'”’»)]}*_` \t\r\n 　"


def _unquoted(text: str) -> str:
    return _QUOTED.sub(" ", text) if any(mark in text for mark in "“„«\"「") else text


def _phrases() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for kind, phrases in (("whole", DECLINING), ("unable", UNABLE), ("barred", BARRED), ("answering", ANSWERING), ("speaker", SPEAKERS), ("denial", DENIALS), ("lack", LACKS)):
        for phrase in map(str.strip, re.split(r"[;\n]", phrases)):
            if phrase:
                key = f" {phrase} "
                automaton.add_word(key, (len(key), automaton.get(key, (0, frozenset()))[1] | {kind}))
    automaton.make_automaton()
    return automaton


_automaton: ahocorasick.Automaton | None = None


def is_refusal(answer: str) -> bool:
    global _automaton
    if _automaton is None:
        _automaton = _phrases()
    text = _unquoted(answer)
    if not _ANY_WORD.search(text):
        text = answer
    if _UNBLANKED.search(text) and any(phrase in text for phrase in UNPARTED):
        return True
    plain = f" . {_SENTENCES.sub(' . ', _PLAIN.sub(' ', text.casefold()))} . ".replace("  ", " ")
    hits = [(end - n + 1, end, kinds) for end, (n, kinds) in _automaton.iter(plain)]
    if any("whole" in kinds for _, _, kinds in hits):
        return True
    if len(hits) < 2:
        return False
    by_sentence: dict[int, list[tuple[int, int, frozenset[str]]]] = {}
    for begin, end, kinds in hits:
        by_sentence.setdefault(plain.count(".", 0, end), []).append((begin, end, kinds))
    return any(map(_declines, by_sentence.values()))


def _declines(hits: list[tuple[int, int, frozenset[str]]]) -> bool:
    """Whether the parts in one sentence decline together."""
    there = frozenset().union(*(kinds for _, _, kinds in hits))
    if {"speaker", "denial"} <= there or {"speaker", "lack", "answering"} <= there:
        return True
    verbs = [(begin, end) for begin, end, kinds in hits if "answering" in kinds] if there & {"unable", "barred"} else []
    return any(
        "unable" in kinds and 0 <= verb[0] - end <= SOON or "barred" in kinds and (verb[0] >= end or verb[1] <= begin)
        for begin, end, kinds in hits if kinds & {"unable", "barred"} for verb in verbs
    )


class Prompt:
    """A prompt's suffix automaton and language."""

    def __init__(self, text: str):
        self.words = words_of(text)
        self.vocabulary = set(self.words)
        self.number = {w: i for i, w in enumerate(self.vocabulary)}
        self.automaton = Automaton()
        self.automaton.add([self.number[w] for w in self.words], 0)
        self.language = language(text, 0.5)
        # an answer that gives back nearly all of the prompt holds one of its longest words
        self.longest = sorted(self.vocabulary, key=len)[-max(1, int(len(self.words) * (1 - COPY_SHARE)) + 1) :]

    def is_copied(self, answer: str) -> bool:
        if 2 * len(answer) < sum(map(len, self.words)):
            return False
        folded = answer.casefold()
        if not any(w in folded for w in self.longest):
            return False
        words = words_of(answer)
        if not words or not self.words or sum(w in self.vocabulary for w in words) < COPY_SHARE * len(self.words):
            return False
        step, link, size = self.automaton.step, self.automaton.link, self.automaton.size
        covered = [False] * len(words)
        given: set[int] = set()
        state = length = 0
        for at, w in enumerate(words):
            n = self.number.get(w, -1)
            while (to := step(state, n)) < 0 and state:
                state = link[state]
                length = size[state]
            if to < 0:
                continue
            state, length = to, length + 1
            if length >= COPY_RUN:
                covered[at - length + 1 : at + 1] = [True] * length
                given.update(range(at - length + 1, at + 1))
        back = {words[i] for i in given}
        rest = [w for w, c in zip(words, covered, strict=True) if not c]
        whole = sum(w in back for w in self.words) >= COPY_SHARE * len(self.words)
        return whole and len(rest) <= FRAME_WORDS and all(w in FRAME or w in self.vocabulary for w in rest)


@lru_cache(1 << 16)
def _votes_of(word: str) -> tuple[tuple[str, float], ...]:
    """The languages that a word speaks for, each with its share of the word's vote."""
    told = _VOTES.get(word.casefold(), [])
    if not told and word[1:2] == "’" and word[0] in "ldcjmnstLDCJMNST":
        told = ["fr", "fr", "it"]
    if not told and word.islower():
        told = next((ENDINGS[word[-n:]].split() for n in (6, 5, 4, 3, 2) if len(word) > n + 2 and word[-n:] in ENDINGS), None) or next((LETTERS[c].split() for c in word if c in LETTERS), [])
    return tuple((one, 1 / len(told)) for one in told)


def language(text: str, least: float = LEAST) -> tuple[str, dict[str, float]] | None:
    """The language with the most votes, if it has `least`, with all votes; None if nothing votes. A function word, an
    ending or a letter that several languages share is split between them."""
    ascii = text.isascii()
    han, cyrillic = (0, 0) if ascii else (len(_HAN.findall(text)), len(_CYRILLIC.findall(text)))
    letters = sum(map(str.isalpha, text)) if han or cyrillic else 0
    if han and 5 * han >= letters:
        return "zh", {"zh": han}
    if cyrillic and 3 * cyrillic >= letters:
        return "ru", {"ru": cyrillic}
    votes: dict[str, float] = {}
    for word in _LETTERS.findall(_unquoted(text)):
        for one, share in _votes_of(word):
            votes[one] = votes.get(one, 0) + share
    if not votes:
        return None
    best = max(votes, key=votes.__getitem__)
    return (best, votes) if votes[best] >= least else None


def is_foreign(answer: str, asked: tuple[str, dict[str, float]] | None) -> bool:
    told = language(answer)
    if asked is None or told is None or told[0] == asked[0]:
        return False
    return told[1][told[0]] >= told[1].get(asked[0], 0) + LEAD


def open_delimiters(text: str) -> list[str]:
    """The delimiters left open at the end: code fences first, brackets outside of code."""
    stack: list[str] = []
    pairs = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}
    for m in _DELIMITERS.finditer(text):
        mark = m[0].strip()
        if mark in ("```", "~~~"):
            if "```" in stack:
                del stack[stack.index("```") :]
            else:
                stack.append("```")
        elif "```" in stack:
            continue
        elif mark in pairs:
            if pairs[mark] in stack:
                while stack.pop() != pairs[mark]:
                    pass
        else:
            stack.append(mark)
    return stack


def is_truncated(answer: str, full: bool = False) -> bool:
    """`full`: as many tokens came out as were allowed."""
    text = answer.rstrip(" \t\r\n 　​﻿")
    left_open = open_delimiters(text)
    if "```" in left_open:
        return True
    if text.endswith(("```", "~~~")):
        return False
    bare = text.rstrip(_CLOSERS)
    if not bare:
        return False
    if bare[-1] in _TERMINAL:
        return False
    if bare[-1] in ",:;–—-([{/=+&«“„、，：；（" or (text[-1] in "([{“«"):
        return True
    lines = [line for line in text.split("\n") if line.strip()]
    item = _ITEM.match(lines[-1])
    tail = lines[-1]
    if item:
        before = [line.rstrip().rstrip(_CLOSERS) for line in lines[:-1] if _ITEM.match(line)]
        tail = lines[-1].split(None, 1)[1]
        ended = [line[-1:] in _TERMINAL for line in before if line]
        if ended:
            return all(ended) or bool(_INNER_END.search(tail))
    if _INNER_END.search(tail):
        return True
    if not item and len(lines) > 1 and lines[-2].rstrip()[-1:] in _TERMINAL and len(tail.split()) > 4:
        return True
    words = tail.split()
    if len(words) == 1 and len(tail) > 30 and any("一" <= c <= "鿿" for c in tail):
        return True
    most = PHRASE_WORDS - 3 if full else PHRASE_WORDS
    return len(words) >= most + bool(item) or len(words) > 1 and words[-1].casefold() in OPEN_WORDS or bool(left_open) and len(words) > 4


def defect(answer: str | None, prompt: Prompt | None, full: bool = False) -> str | None:
    """The defect of one answer, or None."""
    if answer is None or not _SIGN.search(answer):
        return "empty"
    if is_refusal(answer):
        return "refusal"
    if prompt and prompt.is_copied(answer):
        return "copy"
    if prompt and is_foreign(answer, prompt.language):
        return "language"
    return "truncated" if is_truncated(answer, full) else None


def broken_pairs(runs: DataFrame, prompts: DataFrame, key: str = "run_id", on: str = "doc_id", answer: str = "answer", prompt: str = "query_prompt", tokens: str = "num_output_tokens", allowed: str = "max_new_tokens") -> DataFrame:
    """key, defect: one row per run with a defective answer.

    A run delivered more than once gives one row (of its deliveries' defects the first by name, should they differ); rows
    with a null key give one row per defect. A null answer is `empty`. Without a prompt, `copy` and `language` are not
    looked for; of repeated prompts of one id any copy serves. Empty tables give no rows; null counts count as unknown.
    """
    asked = prompts.filter(F.col(on).isNotNull()).groupBy(F.col(on).alias("__on")).agg(F.min(prompt).alias("prompt"))
    own = runs.select(F.col(key).alias("key"), F.col(on).alias("__on"), F.col(answer).alias("answer"), (F.col(tokens) >= F.col(allowed)).alias("full"))
    pairs = own.join(asked, "__on", "left").select("key", "answer", "prompt", "full")
    kind = pairs.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Prompt] = {}
        for batch in batches:
            rows, out = [], []
            seen: dict[tuple, str | None] = {}  # the same answer to the same prompt, in this batch
            for i, pair in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                if pair not in seen:
                    a, p, full = pair
                    if p is not None and p not in known:
                        if len(known) >= KEEP:
                            known.clear()
                        known[p] = Prompt(p)
                    seen[pair] = defect(a, known[p] if p is not None else None, bool(full))
                found = seen[pair]
                if found:
                    rows.append(i)
                    out.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(out, pa.string())], ["key", "defect"])

    found = pairs.mapInArrow(run, f"key {kind}, defect string")
    return found.groupBy("key").agg(F.min("defect").alias("defect")).withColumnRenamed("key", key)
