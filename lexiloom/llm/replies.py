"""Defects of prompt and response pairs: clauses tagged by a conditional random field, coverage gathered into one defect.

A response is cut into clauses: the values of its lists, numbered lines, and sentences of what stands around them. A CRF tags each as
answer, refusal, echo, foreign or unfinished, from its words, its kind and place, how much of it stands in the prompt, how foreign its
words look, and whether brackets, quotes, numbers or sentences stay open.

Nothing of the replies is used to fit the field, and none of the data has labels. It is fitted on ``TRAIN`` replies composed from the phrases
below, and its words come from the public tokenizers' vocabularies (``LEXILOOM_TOKENIZERS``): a word that an English vocabulary has is English,
one that only the many-language vocabulary has isn't (``Languages``). So the fit is the same for all data and is made once in a process. When the
operator runs, the words of all canonical entries count as English too (at most ``VOCABULARY``; more are an error). Every row is judged, and whole texts.

A pair's defect, in this order: ``empty`` (no clause holds a letter or digit), ``truncated`` (the last clause is unfinished),
none (a guess in English is an answer), else the tag that covers the most words: ``copies_question``, ``refusal``, ``other_language``, or none for ``answer``.

The answer is the response, or the content of the second column where that is null; both null is empty. A missing prompt is the empty
text, of which no answer is a copy. A null ord is kept. Replies without prompt are spread over all partitions. Repeated rows give repeated
results, if the prompts' key is unique. JSON nested deeper than the parser goes is read as prose. Further columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.crf import CRF
from lexiloom.llm.encoding import TOKENIZERS

TAGS = ["answer", "refusal", "echo", "foreign", "unfinished"]
TRAIN = 5_000
#: Most words of the canonical entries that are collected and broadcast (about 100 bytes each).
VOCABULARY = 1_000_000

# What the training replies are composed of.
CANNOT = [
    "I can't", "I cannot", "I won't", "I will not", "I am unable to", "I'm not able to", "I don't want to", "I must decline to", "I'd rather not", "I have to refuse to", "I refuse to", "I am not allowed to", "We cannot",
    "I'm afraid I can't", "I do not feel comfortable trying to", "It is not possible for me to", "There is no way for me to", "I don't think I should", "I shouldn't", "I decline to", "I am not in a position to", "My guidelines don't let me",
]
NOTHING = ["answer", "reading", "guess", "meaning", "interpretation", "translation", "response", "list"]
GIVEN = ["will be given", "can be given", "is given", "will be offered", "is offered", "can be provided", "will be provided", "can be made", "is available", "will be supplied", "is possible", "from me"]
KNOW = ["I don't know", "I do not know", "I can't tell", "I cannot say", "I have no idea", "I am not sure", "Nobody could tell", "I don't see", "It is unclear to me", "I am not going to say", "I won't be saying", "I don't have enough to say"]
KNOWN = ["what this means", "what it says", "what the signs mean", "how to read this", "this one", "that word", "what to answer", "what these are", "", "anything about it", "the meaning"]
DO = ["answer", "help with", "guess at", "provide", "decode", "read", "translate", "interpret", "comply with", "complete", "assist with", "respond to", "offer", "give", "produce", "continue with", "take part in", "name", "do", "identify", "discuss"]
WHAT = ["", "meanings", "this", "that", "this request", "this task", "the question", "these symbols", "this word", "a meaning", "an answer", "a guess", "any readings", "such content", "it", "your question", "any interpretation of it", "what you ask for"]
WHY = ["", "", "", "", " here", " at all", " now", " as it is against my rules", " because I lack the context", " without more information", " for safety reasons", " since there is no picture", " because the policy forbids it", ", as that could be harmful", " due to my instructions"]
NO = [
    "This request is declined", "No answer will be given", "No comment", "Request refused", "This goes against my guidelines", "This is outside of what I can do", "I have to pass on this one", "I pass", "I don't know", "I have no idea", "I have no guess",
    "It is not possible to interpret this", "I don't have the ability to see pictures", "There is not enough information to answer", "I am skipping this item for policy reasons", "That is something I may not do", "My policy forbids an answer", "The content is not permitted",
]
SORRY = ["", "", "", "Sorry, ", "I'm sorry, but ", "I am sorry. ", "Unfortunately, ", "Unfortunately ", "I apologise, however ", "I apologize, but ", "As an assistant, ", "As a language model, ", "Regrettably, ", "My apologies, "]
AFTER = ["", "", "", " Please ask a specialist.", " Can I help with anything else?", " Is there something else you would like to ask?", " More details are needed.", " Thank you for your understanding.", " Try another question."]
LEADS = [
    "", "", "", "My answer: ", "Answer: ", "I think ", "Final list: ", "The list: ", "Here it is: ", "I am not certain, but these may fit: ", "Sorry for the long list: ", "Without refusing any reading: ", "I won't claim to be sure, yet I propose ",
    "It is difficult to say. Even so, my choice is ", "I cannot be sure; my options are ", "For the spelling {code} I suggest ", "{code}: ", "From the parts I conclude ", "I don't know for certain. Perhaps ", "Not an easy one, but here goes: ", "Unable to see a picture, I still propose ", "After some thought: ",
]
TAILS = ["", "", " The last one is a stretch.", " The order is by trust.", " I can't say more than that.", " These are close to each other.", " Sorry if that is too broad.", " Hope this helps!", " The rest is less likely.", " Number two is more literal than the others."]
TRUST = [" I am", " I feel", " Not", " Quite", " I can't be", " I am not"]
SURE = ["certain", "confident", "sure", "convinced", "at ease"]
OF = ["about", "of", "with", "as to"]
WHICH = ["most of these", "the top one", "the last", "any of them", "my choice", "all of these", "the second one"]
NOTES = ["in order of trust", "Taken from the parts.", "the last two are hard to tell apart", "a loose reading", "cannot be sure"]
MEANS = ["probably means", "means", "may mean", "could mean", "likely stands for", "stands for", "reads as", "is", "seems to be", "might denote", "points to", "refers to", "most likely is", "looks like"]
FRAMES = ["{0}, I suppose.", "I'd pick {0}.", "I choose {0} over {1}.", "So {0} it is.", "Possibly {0}.", "{0} is closest.", "{0} or {1}, I guess.", "Either {0} or {1}.", "Let us say {0}.", "We get {0} from the parts, or {1}."]
PROMISE = ["I can't promise", "Cannot rule out", "I won't swear to", "No guarantee for", "I do not know", "I have no proof of", "Unable to check", "I can't confirm", "I am not allowed to see", "I refuse to bet on"]
THINGS = ["it", "anything", "much", "this", "all of it", "that", "the details", "the whole word"]
YET = [", but ", ", yet ", ", still ", "; anyway, ", ", though ", ". Even so, "]
ABOUT = ["It", "This", "The meaning", "The reading", "My guess", "My reading", "The answer", "The word", "The sign", "This word", "The spelling", "This one", "The whole"]
HEDGES = ["", "", "", "Not sure, but ", "I can't be certain, but ", "My best guess: ", "Perhaps ", "I would say that ", "I believe ", "Sorry, I am guessing here: ", "Hard to tell. "]
ALSO = [" {0}.", " {0} or {1}.", " {0}, or perhaps {1}.", " {0}; {1} is possible too.", ' "{0}".', ' "{0}" or "{1}".', " {0} since the helpers say so, and a wider reading would give {1}.", " {0} as the parts suggest, while in another sense it would be {1}.", " {0} and, if the mark is read in another way, {1} as well."]
NUMBERED = ["Here are my {n} guesses:", "Top {n}:", "{n} candidates, best first:", "My list of {n}:", "", "Guesses:"]
QUESTIONS = [
    "Decode this word. Answer in English only with a JSON array of at most five readings.", "Below is a word in picture symbols. Give its meaning as a JSON list.", "What does this symbol word say? Offer guesses, strongest first.",
    "Guess the headword for these glyphs and return nothing but a list.", "Which English word do these signs spell? Reply with a list.", 'Give up to four meanings in a list, for example ["one", "two"].', 'Reply in JSON only, like {"candidates": ["a word", "another word"]}.',
]

_WORD = re.compile(r"[^\W_]+(?:['’][^\W\d_]+)*")
_ITEM = re.compile(r"^\s*(?:\d+\s*[.)]|[-*•])\s*(.*)$")
_NUMBERED = re.compile(r"^\s*\d+\s*[.)]")
_FENCE = re.compile(r"```[a-zA-Z]*")
_SENTENCE = re.compile(r"(?<=[.!?。;])\s+|\n+")
_QUOTED = re.compile(r'"([^"\n]*)"|“([^”\n]*)”|«\s*([^»\n]*?)\s*»|「([^」\n]*)」')
_BRACKET = re.compile(r"[\[{]")
_BRACKETS = re.compile(r"[\[{\s]+")
_NUMBER_WORDS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten".split())}
_EDGES = " \t\r\n 　​‌‍⁠﻿"
_DECODER = json.JSONDecoder()


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower().replace("’", "'"))


def _flat(v, found: list[tuple[str, str]], listed: bool) -> None:
    """The texts of a JSON value: of lists as items, others as fields."""
    if isinstance(v, str):
        found.append(("item" if listed else "field", v))
    elif isinstance(v, list):
        for x in v:
            _flat(x, found, True)
    elif isinstance(v, dict):
        for x in v.values():
            if not (isinstance(x, str) and len(x.split()) < 2):  # a one-word field is a label
                _flat(x, found, False)


def _lists(text: str) -> Iterator[tuple[int, int, object]]:
    """Where JSON lists and objects stand in a text."""
    at = 0
    while (m := _BRACKET.search(text, at)) is not None:
        try:
            v, end = _DECODER.raw_decode(text, m.start())
            yield m.start(), end, v
            at = end
        except ValueError:
            at = m.start() + 1
        except RecursionError:
            at = _BRACKETS.match(text, m.start()).end()


def clauses(text: str) -> tuple[list[tuple[str, str]], bool, str]:
    """``(kind, text)`` of each clause, kind item, field (of an object) or prose; whether the response stays open; how it ends: as one JSON value (json), in a word (word) or otherwise."""
    body = _FENCE.sub("\n", text).strip(_EDGES) if "```" in text else text.strip(_EDGES)
    found: list[tuple[str, str]] = []
    if not body:
        return found, False, ""
    if body[0] in '[{"' or body[0].isdigit() or body in ("null", "true", "false"):
        try:
            v = json.loads(body)
            _flat(v, found, isinstance(v, (list, str)))
            return [(k, x) for k, x in found if _WORD.search(x)], False, "json"
        except (ValueError, RecursionError):
            found = []
    rest: list[tuple[str, list[tuple[str, str]]]] = []
    at, bare = 0, ""
    for start, end, v in _lists(body):
        inside: list[tuple[str, str]] = []
        try:
            _flat(v, inside, isinstance(v, list))
        except RecursionError:
            continue
        rest.append((body[at:start], inside))
        bare += body[at:start]
        at = end
    open_ = False
    announced, counted = None, 0
    for piece, inside in [*rest, (body[at:], [])]:
        for line in piece.split("\n"):
            m = _ITEM.match(line)
            if m:
                numbered = bool(_NUMBERED.match(line))
                counted += numbered
                if _WORD.search(m[1]):
                    found.append(("item", m[1].strip()))
                elif numbered and not m[1].strip():
                    open_ = True
                    counted -= 1
                continue
            if announced is None and line.rstrip().endswith(":"):
                n = re.search(r"\d+", line)
                named = [_NUMBER_WORDS[w] for w in words_of(line) if w in _NUMBER_WORDS]
                announced = int(n[0]) if n and len(n[0]) < 3 else named[0] if named else None
            for sentence in _SENTENCE.split(line):
                if '"' in sentence:  # what is quoted is a guess for itself
                    quoted = [("item", q) for g in _QUOTED.findall(sentence) if _WORD.search(q := "".join(g))]
                    sentence = _QUOTED.sub('""', sentence)
                else:
                    quoted = []
                if _WORD.search(sentence):
                    found.append(("prose", sentence.strip()))
                found += quoted
        found += [(k, x) for k, x in inside if _WORD.search(x)]
    left = bare + body[at:]
    open_ |= left.count("[") > left.count("]") or left.count("{") > left.count("}")
    open_ |= left.count('"') % 2 == 1 and not counted and body[-1] not in ".!?"  # typed quotes needn't be paired
    open_ |= bool(counted and announced is not None and counted < announced)
    return found, open_, "word" if body[-1].isalnum() else ""


def _latin(word: str) -> bool:
    return word.isascii() or all("LATIN" in unicodedata.name(c, "") for c in word if c.isalpha())


def _folded(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def _shorter(word: str) -> set[str]:
    """The word, and it with a letter left out."""
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


@cache
def vocabularies(tokenizers: str) -> tuple[frozenset[str], frozenset[str], frozenset[str]]:
    """Words that two English vocabularies have, that one of them has, and that only the many-language vocabulary has."""
    import base64

    def spaced(name: str) -> dict[str, int]:
        out: dict[str, int] = {}
        with open(f"{tokenizers}/{name}", "rb") as f:
            for piece, rank in map(bytes.split, f):
                word = base64.b64decode(piece).decode("utf-8", "replace")
                if word[:1] == " " and len(word) > 2 and word[1:].isalpha():
                    out.setdefault(word[1:].lower(), int(rank))
        return out

    ranks, other = spaced("byte_bpe_50k.tiktoken"), spaced("byte_bpe_multi_50k.tiktoken")
    # short words are in all vocabularies; those of other languages come much sooner among many languages
    abroad = {w for w, r in other.items() if len(w) < 5 and r < 0.45 * ranks.get(w, 60_000) and r < 15_000}
    first = {w for w in ranks if w.isascii()} - abroad
    with open(f"{tokenizers}/word_bpe_49k.json", encoding="utf-8") as f:
        second = {w[:-4] for w in json.load(f)["model"]["vocab"] if w.endswith("</w>") and len(w) > 5 and w[:-4].isalpha() and w.isascii()} - abroad
    return frozenset(first & second), frozenset(first ^ second), frozenset(other.keys() - first - second)


class Languages:
    """How foreign a word looks, from 0 to 1: by what vocabularies have it, and for words of none by naive Bayes over runs of two to four letters."""

    RUNS = (2, 3, 4)

    def __init__(self, sure: set[str], some: set[str], foreign: set[str]):
        self.sure, self.some, self.foreign = set(sure), set(some), set(foreign)
        self.listed: set[str] = set()
        self.near: set[str] = set()
        english, other = self.sure | self.some, {w for w in self.foreign if _latin(w)}
        # a word's sum is set against words that its runs weren't counted from: a half is counted and the other half measured
        half = [[[w for w in words if (len(w) + sum(map(ord, w))) % 2 == k] for k in (0, 1)] for words in (english, other)]
        counts = [[self._counted(words) for words in both] for both in half]
        self.score = self._weights(counts[0][0], counts[1][0])
        x = np.array([self.sum(w) for both in half for w in both[1]] or [0.0])
        y = np.repeat([0.0, 1.0], [len(half[0][1]), len(half[1][1])]) if half[0][1] or half[1][1] else np.zeros(1)
        weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
        at = np.stack([x, np.ones_like(x)], axis=1)
        line = np.array([1.0, 0.0])
        for _ in range(20):  # logistic regression by Newton's steps
            p = 1 / (1 + np.exp(-np.clip(at @ line, -30, 30)))
            line += np.linalg.solve((at.T * (weight * p * (1 - p))) @ at + 1e-6 * np.eye(2), at.T @ (weight * (y - p)) - 1e-6 * line)
        self.slope, self.shift = map(float, line)
        self.score = self._weights(counts[0][0] + counts[0][1], counts[1][0] + counts[1][1])
        self._known: dict[str, float] = {}
        self._order: list[str] | None = None

    def list(self, words: set[str]) -> Languages:
        """The same languages, in which also ``words`` are English, and what is a letter away from one that isn't short nearly is."""
        out = object.__new__(Languages)
        out.__dict__ = {**self.__dict__, "listed": set(words), "near": {s for w in words if len(w) > 3 for s in (_shorter(w) if len(w) > 4 else [w])}, "_known": {}, "_order": None}
        return out

    @classmethod
    def _grams(cls, word: str) -> list[str]:
        w = f"^{word}$"
        return [w[i : i + n] for n in cls.RUNS for i in range(len(w) - n + 1)]

    def _counted(self, words: list[str]) -> Counter:
        return Counter(g for w in words for g in self._grams(w))

    @staticmethod
    def _weights(english: Counter, other: Counter) -> dict[str, float]:
        every = english.keys() | other.keys()
        sizes = [sum(c.values()) + 0.5 * (len(every) + 1) for c in (english, other)]
        return {g: math.log((other[g] + 0.5) / sizes[1]) - math.log((english[g] + 0.5) / sizes[0]) for g in every}

    def sum(self, word: str) -> float:
        get = self.score.get
        return sum(get(g, 0.0) for g in self._grams(word)) / len(word)

    def __call__(self, word: str) -> float:
        p = self._known.get(word)
        if p is None:
            if len(self._known) > 200_000:
                self._known.clear()
            p = self._known[word] = self._judged(word)
        return p

    def _judged(self, word: str) -> float:
        if not _latin(word):
            return 1.0
        plain = word.removesuffix("'s") if "'" in word else word
        if plain in self.listed or plain in self.sure or "'" in word:
            return 0.0
        folded = _folded(plain)
        if any(folded.endswith(e) and folded[: -len(e)] in known for e in ("s", "es", "ed", "ing", "er", "ly") for known in (self.listed, self.sure)):
            return 0.1
        if folded in self.listed or folded in self.near or (len(folded) > 4 and not self.near.isdisjoint(_shorter(folded))):
            return 0.1
        if any((folded[i:] in self.listed and (folded[:i] in self.listed or folded[:i] in self.sure)) or (3 < i < len(folded) - 3 and folded[:i] in self.sure and (folded[i:] in self.sure or folded[i:] in self.some)) for i in range(3, len(folded) - 2)):
            return 0.1  # written together
        if folded != plain and len(folded) > 4 and folded in self.sure:
            return 0.3
        shift = self.shift + (-3.0 if plain in self.some else 3.0 if plain in self.foreign else 1.0)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * self.sum(plain) + shift))))

    def is_stub(self, word: str) -> bool:
        """Whether the word is none that is known, but the beginning of one."""
        if word in ("a", "i") or word in self.listed or word in self.sure or word in self.some:
            return False
        if self._order is None:
            self._order = sorted(self.sure | self.listed)
        i = bisect_left(self._order, word)
        return i < len(self._order) and self._order[i].startswith(word)

    def __getstate__(self):
        return {**self.__dict__, "_known": {}, "_order": None}


class Prompt:
    """A prompt's words, for looking up runs of five."""

    def __init__(self, text: str):
        words = words_of(text)
        self.text, self.words = f" {' '.join(words)} ", set(words)


def _in_prompt(words: list[str], prompt: Prompt) -> float:
    """The share of the runs of five words that the prompt has."""
    n = len(words) - 4
    text = prompt.text
    return sum(f" {' '.join(words[i : i + 5])} " in text for i in range(n)) / n


def _fifths(x: float) -> int:
    return min(4, int(x * 5))


def described(found: list[tuple[str, str]], open_: bool, end: str, prompt: Prompt, lang: Languages) -> list[tuple[tuple, list[str]]]:
    """Of each clause its traits, which are few and repeat, and its words."""
    cut = [words_of(x) for _, x in found]
    every = [w for ws in cut for w in ws]
    asked = len(prompt.words) > 0
    whole = _in_prompt(every, prompt) if asked and len(every) > 4 else 0.0
    n_items = sum(k == "item" for k, _ in found)
    out = []
    for i, ((kind, text), words) in enumerate(zip(found, cut)):
        known = len([w for w in words if w in prompt.words])
        echo = (_in_prompt(words, prompt) if len(words) > 4 else whole if known == len(words) else 0.0) if asked else 0.0
        letters = [w for w in words if len(w) > 1 and (w.isalpha() or not any(c.isdigit() for c in w)) or w > "\u02ff"]
        alien = sum([lang(w) * len(w) for w in letters]) / sum(map(len, letters)) if letters else 0.0
        last = i == len(found) - 1
        shut = text[-1:] in ".!?)]}:;\"”»」。…"
        stub = last and end == "word" and bool(letters) and words[-1] == letters[-1] and lang.is_stub(letters[-1])
        seen = known > 0.8 * len(words)
        traits = (kind, _fifths(echo), _fifths(whole), _fifths(alien), min(6, len(words)), last, min(3, n_items), open_ and last, last and kind == "prose" and not shut and n_items == 0, last and kind == "prose" and not shut, asked, seen, stub, end, last and shut)
        out.append((traits, words))
    return out


def traits_of(t: tuple) -> list[str]:
    kind, echo, whole, alien, size, last, items, open_, cut, loose, asked, seen, stub, end, shut = t
    steps = [f"{name}>{i}" for name, n in (("echo", echo), ("whole", whole), ("alien", alien), (f"{kind}|alien", alien)) for i in range(n)]
    return steps + [
        f"native={alien == 0}", f"native={alien == 0}|{kind}", f"native={alien == 0}|{kind}|{min(items, 2)}|{last}", f"kind={kind}", f"size={size}", f"last={last}", f"items={items}", f"{kind}|items={items > 0}", f"open={open_}", f"cut={cut}", f"cut|echo={loose}|{echo > 2}", f"asked={asked}|{whole > 2}", f"seen={seen}",
        f"stub={stub}|{kind}|{items > 0}", f"end={end}|{kind}|{last}", f"shut={shut}|{kind}", f"{kind}|seen={seen}|{min(size, 5)}",
    ]


def word_features(words: list[str]) -> list[str]:
    """Short clauses are known by their words, longer ones also by pairs of words."""
    single = [f"w={w}" for w in words]
    return single if len(words) < 3 else single + [f"b={a} {b}" for a, b in zip(words, words[1:])]


class Judge:
    """The field with the languages; what repeats is looked up once."""

    def __init__(self, field: CRF, lang: Languages):
        self.field, self.lang = field, lang
        self._traits: dict[tuple, list[float]] = {}
        self._prompts: dict[str, Prompt] = {}

    def __getstate__(self):
        return {"field": self.field, "lang": self.lang, "_traits": {}, "_prompts": {}}

    def _emission(self, traits: tuple, words: list[str]) -> list[float]:
        e = self._traits.get(traits)
        if e is None:
            e = self._traits[traits] = self.field.emission(traits_of(traits))
        return self.field.emission(word_features(words), e)

    def defect(self, text: str | None, prompt: str | None) -> tuple[str | None, dict[str, int]]:
        """The defect of a pair, None for a sound one, and the number of words by tag."""
        found, open_, end = clauses(text or "")
        if not found:
            return ("truncated" if open_ and words_of(text or "") else "empty"), {}
        asked = self._prompts.get(prompt or "")
        if asked is None:
            if len(self._prompts) > 1000:
                self._prompts.clear()
            asked = self._prompts[prompt or ""] = Prompt(prompt or "")
        every = described(found, open_, end, asked, self.lang)
        tags = self.field.tag([self._emission(*d) for d in every])
        cover, guessed = dict.fromkeys(TAGS, 0), dict.fromkeys(TAGS, 0)
        for (kind, _), (_, words), t in zip(found, every, tags):
            cover[t] += len(words)
            if kind == "item":
                guessed[t] += len(words)
        if tags[-1] == "unfinished":
            return "truncated", cover
        if guessed["answer"]:
            return None, cover
        of = guessed if any(guessed.values()) else cover
        most = max(TAGS, key=of.__getitem__)
        return {"answer": None, "refusal": "refusal", "echo": "copies_question", "foreign": "other_language", "unfinished": "truncated"}[most], cover


def training(english: list[str], listed: list[str], rare: list[str], foreign: list[str], size: int, seed: int = 7) -> list[tuple[str, str, str, set[str]]]:
    """Composed replies: text, prompt, the tag of its clauses (of unfinished ones that of the last), and which clauses of an answer are foreign.

    ``listed`` words are those of canonical entries, which are mistyped.
    """
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: rng.random() < p
    out = []

    def typo(w: str) -> str:
        i = int(rng.integers(len(w)))
        return pick([w[:i] + w[i + 1 :], w[:i] + w[i] + w[i:], w[:i] + pick("aeinrst") + w[i:], w[:i] + pick("aeinrst") + w[i + 1 :]]) or w

    def word() -> str:
        if chance(0.03):
            return pick(rare)
        w = pick(listed) if chance(0.6) else pick(english)
        return typo(w) if w in listed and len(w) > 4 and chance(0.1) else w

    def guess() -> str:
        g = " ".join(word() for _ in range(int(rng.choice([1, 1, 2, 2, 2, 3]))))
        return g.upper() if chance(0.05) else g.capitalize() if chance(0.2) else f"to {g}" if chance(0.15) else g

    def guesses() -> list[str]:
        return [guess() for _ in range(int(rng.integers(1, 6)))]

    def prompt() -> str:
        code = "/".join(f"B{int(rng.integers(1, 1500))}" for _ in range(int(rng.integers(2, 6))))
        text = f"{pick(QUESTIONS)}\n\nSpelling: {code}  ({code.count('/') + 1} characters)"
        if chance(0.5):
            text += "\nHelpers found inside:\n" + "\n".join(f"  - B{int(rng.integers(1, 1500))}: {g}" for g in guesses()[:3])
        return text + ("\nGrammar mark: thing" if chance(0.4) else "")

    def wrap(texts: list[str], asked: str = "") -> str:
        r = rng.random()
        if r < 0.4:
            return json.dumps(texts, ensure_ascii=False, indent=pick([None, None, 1]))
        if r < 0.5:
            return "```json\n" + json.dumps(texts, ensure_ascii=False, indent=1) + "\n```"
        if r < 0.62:
            return json.dumps({pick(["candidates", "guesses"]): texts, "note": pick(NOTES)}, ensure_ascii=False)
        if r < 0.78:
            mark = pick(["{i}. ", "{i}. ", "{i}) ", "- ", "* "])
            return (pick(NUMBERED).format(n=len(texts)) + "".join("\n" + mark.format(i=i) + t for i, t in enumerate(texts, 1))).strip()
        return pick(LEADS).replace("{code}", asked.partition("Spelling: ")[2].partition(" ")[0]) + json.dumps(texts, ensure_ascii=False) + (f"{pick(TRUST)} {pick(SURE)} {pick(OF)} {pick(WHICH)}." if chance(0.4) else pick(TAILS))

    def refusal() -> str:
        text = f"{pick(CANNOT)} {pick(DO)} {pick(WHAT)}".rstrip() + pick(WHY) if chance(0.55) else pick(NO) if chance(0.5) else f"{pick(KNOW)} {pick(KNOWN)}".rstrip() if chance(0.5) else f"No {pick(NOTHING)} {pick(GIVEN)}{pick(WHY)}"
        start = pick(SORRY)
        return start + (text[0].lower() + text[1:] if start.endswith(", ") and text[:2] not in ("I ", "I'") else text) + pick([".", ".", "", "!"]) + pick(AFTER)

    def said(a: str, b: str) -> str:
        if chance(0.25):
            return pick(FRAMES).format(a, b)
        lead, about = pick(HEDGES) if chance(0.7) else f"{pick(PROMISE)} {pick(THINGS)}{pick(YET)}", pick(ABOUT)
        return (lead + (about if not lead or lead.endswith(". ") else about.lower()) + " " + pick(MEANS) + pick(ALSO).format(a, b)).strip()

    strangers = set(foreign)
    short = [w for w in english if len(w) < 4]
    kinds = [[w for w in foreign if _latin(w)], [w for w in foreign if not _latin(w)]]
    kinds = [k for k in kinds if k]

    def strange(n: int) -> list[str]:
        words = kinds[0] if len(kinds) == 1 or chance(0.75) else kinds[1]
        return [pick(words) for _ in range(n)]

    for _ in range(size):
        p, r = prompt(), rng.random()
        if r < 0.4:
            q = rng.random()
            given, odd = guesses(), pick(foreign) if chance(0.6) else guess()
            if q < 0.1:
                given.insert(int(rng.integers(len(given) + 1)), odd)
            text = wrap(given, p) if q < 0.7 else said(guess(), guess()) if q < 0.9 else guess() + pick(["", ".", f" or {guess()}"])
            if 0.1 < q < 0.25 and not text.startswith("{"):
                text += f'\n{pick(["Note: related to", "Compare also", "See also", "In another language this is", "Elsewhere one says"])} "{odd}".'
            out.append((text, p, "answer", {odd} if q < 0.25 and odd in strangers else set()))
        elif r < 0.55:
            text, q = refusal(), rng.random()
            text = json.dumps({"candidates": [], "note": text}) if q < 0.15 else json.dumps([text]) if q < 0.35 else text + "\n[]" if q < 0.41 else "[]\n" + text if q < 0.45 else text
            out.append((text, p, "refusal", set()))
        elif r < 0.7:
            lines = p.split("\n")
            q = rng.random()
            text = p if q < 0.3 else lines[0] if q < 0.5 else p.upper() if q < 0.6 else " ".join(p.split()) if q < 0.7 else "\n".join(lines[2:]) if q < 0.85 else pick(["Q: ", "Question: ", "Task: "]) + p if q < 0.92 else "> " + p.replace("\n", "\n> ")
            out.append((json.dumps([text]) if chance(0.08) else text, p, "echo", set()))
        elif r < 0.85:
            if chance(0.6):
                text = wrap([" ".join(strange(int(rng.choice([1, 1, 1, 2])))) for _ in range(int(rng.integers(1, 5)))])
            else:
                w = [pick(short) if chance(0.25) else x for x in strange(int(rng.integers(4, 12)))]  # short words are shared by many languages
                q = int(rng.integers(1, len(w)))
                w[q] = pick(['"{}"', "{}", "{}", "«{}»", "{},"]).format(w[q])
                text = " ".join(w).capitalize() + pick([".", ".", "", "!"])
                text = json.dumps({"candidates": [], "note": text}, ensure_ascii=False) if chance(0.15) else text + "\n" + json.dumps(strange(int(rng.integers(1, 4))), ensure_ascii=False) if chance(0.3) else text
            out.append((text, p, "foreign", set()))
        else:
            text = wrap(guesses(), p) if chance(0.6) else said(guess(), guess()) if chance(0.7) else refusal()
            text = text[: int(len(text) * rng.uniform(0.35, 0.97))]
            if text.strip():
                out.append((text, p, "unfinished", set()))
    return out


@cache
def fitted(tokenizers: str = TOKENIZERS, size: int = TRAIN) -> tuple[CRF, Languages]:
    """The field and the languages. While the field is fitted, half of the words are unknown, as words of replies may be."""
    sure, some, foreign = vocabularies(tokenizers)
    known = lambda w: sum(map(ord, w)) % 2 == 0
    half = Languages(sure, {w for w in some if known(w)}, {w for w in foreign if known(w)})
    listed = [w for w in sorted(sure) if len(w) > 3 and sum(map(ord, w)) % 37 == 5]
    half = half.list(set(listed))
    x, y = [], []
    for text, prompt, tag, odd in training(sorted(sure), listed, sorted(w for w in some if not known(w)), sorted(w for w in foreign if not known(w)), size):
        found, open_, end = clauses(text)
        d = described(found, open_, end, Prompt(prompt), half)
        if not found or tag == "unfinished" and (found[-1][1][-1:] in ".!?" or not open_ and found[-1][0] == "item" and not d[-1][0][12]):
            continue  # nothing shows where this was cut
        y.append(["answer"] * (len(found) - 1) + ["unfinished"] if tag == "unfinished" else ["foreign" if t in odd else tag for _, t in found])
        x.append([traits_of(t) + word_features(w) for t, w in d])
    # words tell refusals; answers, echoes, languages and open ends show in the traits
    return CRF(TAGS).fit(x, y, lambda f, t: f[:2] not in ("w=", "b=") or t == "refusal"), Languages(sure, some, foreign)


def listed_words(glosses: DataFrame, limit: int = VOCABULARY) -> set[str]:
    """The words of all canonical entries."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"word": sorted({w for t in batch.column(0).to_pylist() for w in words_of(t)})}, schema=pa.schema([("word", pa.string())]))

    got = glosses.where("gloss is not null").select("gloss").mapInArrow(cut, "word string").distinct().limit(limit + 1).toArrow()
    if len(got) > limit:
        raise ValueError(f"the canonical entries have more than {limit} words")
    return set(got.column(0).to_pylist())


def judge_of(glosses: DataFrame, tokenizers: str = TOKENIZERS) -> Judge:
    field, lang = fitted(tokenizers)
    return Judge(field, lang.list(listed_words(glosses)))


def pairs(submissions: DataFrame, prompts: DataFrame, glosses: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """``ord, defect, answer, refusal, echo, foreign, unfinished``: every pair with its defect (null if sound) and its words by tag."""
    spread = F.when(F.col("interaction_id").isNull(), F.pmod(F.xxhash64("ord", "rawResponseText"), F.lit(1 << 20))).otherwise(0)  # nulls meet nobody and needn't lie together
    replies = submissions.select("ord", F.coalesce(F.col("rawResponseText"), F.col("candidates")).alias("text"), "interaction_id", spread.cast("bigint").alias("_spread"))
    asked = prompts.where("interaction_id is not null").select("interaction_id", "prompt", F.lit(0).cast("bigint").alias("_spread"))
    both = replies.join(asked, ["interaction_id", "_spread"], "left").select("ord", "text", "prompt")
    model = submissions.sparkSession.sparkContext.broadcast(judge_of(glosses, tokenizers))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.value.defect
        for batch in batches:
            got = [of(t, p) for t, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            cover = [pa.array([c.get(t, 0) for _, c in got], pa.int32()) for t in TAGS]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d for d, _ in got], pa.string()), *cover], ["ord", "defect", *TAGS])

    return both.mapInArrow(judge, "ord bigint, defect string, " + ", ".join(f"{t} int" for t in TAGS))


def found(submissions: DataFrame, prompts: DataFrame, glosses: DataFrame, **more) -> DataFrame:
    """``ord, defect`` of the defective pairs."""
    return pairs(submissions, prompts, glosses, **more).where("defect is not null").select("ord", "defect")
