"""Defects of pairs: hand-written cases, the parser, the tiling, and the whole operator on a small table."""

import datetime as dt
import random
from re import _parser

import pytest

from fabula.llm import pairs as P



def shown(summary, words, features, sentence):
    """The labelled fields, as text.render_prompt gives them."""
    lines = [("Summary", summary), ("Words", ", ".join(w for w in words if w)), ("Features", ", ".join(features)), ("Random sentence", sentence)]
    return "".join(f"{label}: {value}\n" for label, value in lines if value) + "Story:\n"


def prompt(summary, words, features, sentence):
    return P.Prompt(shown(summary, words, features, sentence), summary, words, sentence)


PROMPT = prompt("Milo wants to find the kite, yet the fox has other plans.", ["kite", "", None, "brave"], ["Dialogue"], "It was the bluest kite that Milo had ever seen.")
GERMAN = prompt("Niemand wusste, warum der Hund auf dem Markt war.", ["Hund"], [], None)
STORY = "Milo went out with his kite. The wind was strong and he was brave. In the end they all went home."


@pytest.mark.parametrize("story", [None, "", " \n\t", "​", "...", "***", '""', "-", "N/A", "n/a.", "Story:", "Story:\n<|endoftext|>", "Answer: none", "[PAD] [PAD]", "TODO"])
def test_empty(story):
    assert P.defect(story, PROMPT) == "empty"


@pytest.mark.parametrize("story", ["N/A" + " " * 400, "\n" * 500 + "TODO", "- " * 250 + "tbd", "TODO " * 60, "No story. " * 50, "<|pad|> " * 80 + "none", "Story: none " + "." * 600, "ＴＯＤＯ" + " " * 500])
def test_empty_of_any_length(story):
    assert P.defect(story, PROMPT) == "empty"


@pytest.mark.parametrize("story", ["I'm sorry, but I can’t write this story.", "Unfortunately, it would not be right for me to write this at the moment.", "No story will be provided for these words.", STORY.split(". ")[0] + ". To be honest, I have to pass on this one. Please try another prompt.", "As a writing assistant, I won't be writing about this.", "Let's pick a different topic; this one is not suitable for me.", "Es tut mir leid, aber ich kann diese Geschichte leider nicht schreiben.", "Lo siento, no puedo escribir esta historia."])
def test_refusal(story):
    assert P.defect(story, PROMPT) == "refusal"


@pytest.mark.parametrize("story", ["I do not want to write this story.", "I should not write about this.", "I could not continue this story.", "I must say no to this request.", "This isn't right for me.", "I will  not write this story.", "Ich kann diese Geschichte nicht erzählen.", "Ich kann diese Geschichte nicht fortsetzen.", "Ich kann diese Anfrage nicht erfüllen.", "Je préfère ne pas écrire cette histoire.", "Je ne veux pas écrire cette histoire.", "No voy a escribir esta historia.", "No podré continuar el cuento."])
def test_refusal_of_every_wording(story):
    assert P.defect(story, PROMPT) == "refusal"


def _example(r, tree):
    """A random text that a parsed pattern matches."""
    out = []
    for op, value in tree:
        match str(op):
            case "LITERAL":
                out.append(chr(value))
            case "ANY":
                out.append(" ")
            case "IN":
                kind, of = r.choice(value)
                out.append(chr(of) if str(kind) == "LITERAL" else "w")
            case "BRANCH":
                out.append(_example(r, r.choice(value[1])))
            case "SUBPATTERN":
                out.append(_example(r, value[3]))
            case "MAX_REPEAT" | "MIN_REPEAT":
                low, high, of = value
                out += [_example(r, of) for _ in range(r.randint(low, min(high, low + 2)))]
            case "AT":
                pass
            case _:
                raise ValueError(op)
    return "".join(out)


@pytest.mark.parametrize("number", range(len(P._REFUSALS)))
def test_every_branch_of_a_refusal_is_hinted(number):
    r = random.Random(number)
    pattern, _ = P._REFUSALS[number]
    texts = [_example(r, _parser.parse(pattern.pattern)) for _ in range(5000)]
    texts = [t for t in texts if pattern.search(t)]
    assert len(texts) > 500 and [t for t in texts if number not in P._hinted(t)] == []


def test_no_refusal_of_a_character_cut_off():
    assert P.defect(STORY + ' "I\'m sorry, but I can\'t help you write the', PROMPT) == "truncated"


@pytest.mark.parametrize("story", ['"I\'m sorry, but I can\'t help you write the letter," said the fox. They went home.', "“No, I won't continue this story,” said Milo. And he slept.", "Milo would not write the letter. He said he was not able to help with the task."])
def test_no_refusal_of_a_character(story):
    assert P.defect(story, PROMPT) is None


SUMMARY = "Milo wants to find the kite, yet the fox has other plans."


@pytest.mark.parametrize("story", [SUMMARY, SUMMARY.upper(), f"Here is the story: {SUMMARY}", (SUMMARY + " ") * 3, "It was the bluest kite that Milo had ever seen.\n" + SUMMARY, shown(SUMMARY, ["kite", "brave"], ["Dialogue"], None), SUMMARY[:40], SUMMARY[:30]])
def test_prompt_copy(story):
    assert P.defect(story, PROMPT) == "prompt_copy"


def test_a_story_that_holds_its_sentence_is_no_copy():
    assert P.defect(SUMMARY + " " + STORY, PROMPT) is None


@pytest.mark.parametrize("story,prompt", [("Der Hund ging nach Hause und war sehr müde. Niemand wusste, warum er auf dem Markt war.", PROMPT), (STORY, GERMAN), ("Собака пошла домой. Она была очень рада.", PROMPT), ("Milo ran. " + "Le chien ne voulait pas rentrer, car il avait peur dans le jardin. " * 3, PROMPT)])
def test_other_language(story, prompt):
    assert P.defect(story, prompt) == "other_language"


def test_a_foreign_sentence_is_no_other_language():
    assert P.defect(STORY + " Der Hund war nicht müde.", PROMPT) is None


@pytest.mark.parametrize("end", [" He went", " And th", ' "We should go,', ' "We should go.', " (and so on.", " Look:\n```\nx = 1.", " „Wir gehen.", " - first.\n2.", " They met Mr.", " <b>Bold."])
def test_truncated(end):
    assert P.defect(STORY + end, PROMPT) == "truncated"


@pytest.mark.parametrize("end", ["\nThe End", " THE END ♥", " ✨", "\n***", "<|endoftext|>", ' "Good night!" she said.', ' And he said: "Good night!"', " „Gute Nacht!“", " (Really.)", "\n\nFin.", "...", " <b>Bold.</b>"])
def test_whole(end):
    assert P.defect(STORY + end, PROMPT) is None


@pytest.mark.parametrize("story", ["Sorry, but stories about this are off limits for me.", "That theme is one I will leave alone. Try a different one.", "Unfortunately I have to leave this request unanswered.", "Please give me another topic. " + STORY, "Mi dispiace, ma non posso scrivere questa storia.", "Não posso escrever esta história.", "Ik kan dit verhaal helaas niet schrijven."])
def test_refusal_by_grammar(story):
    assert P.defect(story, PROMPT) == "refusal"


@pytest.mark.parametrize("story", ["Küçük köpek bahçede koştu. Sonra eve döndü ve annesi ona sıcak süt verdi. Herkes çok mutluydu.", "Pieni koira juoksi puutarhassa. Sitten hän palasi kotiin ja äiti antoi hänelle lämmintä maitoa.", "Malý pes běhal po zahradě. Potom se vrátil domů a maminka mu dala teplé mléko."])
def test_unknown_language(story):
    assert P.defect(story, PROMPT) == "other_language"


@pytest.mark.parametrize("quotes", ['""', "“”", "„“", "«»", "‘’", "''"])
def test_speech_of_any_length_is_the_characters(quotes):
    speech = quotes[0] + "Oh dear, " + "it is so very late now, " * 400 + "and I will not write this story." + quotes[1]
    assert P.is_refusal("The fox said: " + speech + " Then they went home.") is False
    assert P.is_refusal("I will not write this story. " + speech)


@pytest.mark.parametrize("text,open_", [("\n1. Milk.\n2. Bread.", False), ("\n1. Milk.\n2.", True), ("\n- Milk.\n-  ", True), ("\n1.\n2. Bread.", False), ("\n- (Milk.\n- Bread.", False), ("\n- Milk.\n- (Bread.", True), ("```\n- a\n-\n```", False), ("<ul>\n- a", True), ("He paid 3. Then 4.", False)])
def test_parser_of_lists(text, open_):
    assert P.unclosed("They bought:" + text) is open_


def test_closing_formula_before_a_long_ornament():
    assert P.defect(STORY + "\n(The End" + ")" * 900, PROMPT) is None


def plain_tiles(text, source, least):
    """The definition, step by step: longest free match first, marks on both sides, marks of source lifted at the end."""
    free, laid = [True] * len(text), True
    while laid:
        unused, laid = [True] * len(source), False
        while True:
            matches = []
            for i in range(len(text)):
                for j in range(len(source)):
                    n = 0
                    while i + n < len(text) and j + n < len(source) and free[i + n] and unused[j + n] and text[i + n] == source[j + n]:
                        n += 1
                    matches.append((-n, i, j))
            n, i, j = min(matches, default=(0, 0, 0))
            if -n < least:
                break
            for k in range(-n):
                free[i + k] = unused[j + k] = False
            laid = True
    return [not f for f in free]


@pytest.mark.parametrize("seed", range(30))
def test_tiles_are_greedy_string_tiling(seed):
    r = random.Random(seed)
    text, source = ([r.choice("abcd") for _ in range(r.randint(0, n))] for n in (40, 15))
    assert P.tile(text, source) == plain_tiles(text, source, max(1, min(3, len(source))))


@pytest.mark.parametrize("words", [3, 12, 300])
def test_long_copies_are_tiled_in_stretches(words):
    """A prompt repeated up to 60,000 words is a copy, whole but for the words at the ends of stretches."""
    r = random.Random(words)
    source = [f"w{r.randrange(900)}" for _ in range(words)]
    text = (source * (60_000 // words))[:-1]
    covered = P.tile(text, source)
    assert len(covered) == len(text) and sum(covered) > 0.98 * len(text)
    text[30_000:30_050] = [f"x{i}" for i in range(50)]
    assert not any(P.tile(text, source)[30_000:30_050])


def test_tiles():
    assert P.tile("a b c x a b c d".split(), "a b c d".split()) == [True] * 3 + [False] + [True] * 4
    assert P.tile([], ["a"]) == [] and P.tile(["a"], []) == [False]


def test_long_text_is_read_whole():
    assert P.defect(STORY + " Then he slept." * 20_000 + " And", PROMPT) == "truncated"


@pytest.mark.parametrize("end,defect", [("*" * 300_000, None), ("*" * 300_000 + " and", "truncated"), ('" ' * 100_001, "truncated"), (" ✨" * 100_000 + "\nThe End", None)])
def test_long_ends(end, defect):
    assert P.defect(STORY + end, PROMPT) == defect


def test_operator(spark):
    now = dt.datetime(2025, 1, 1)
    later = now + dt.timedelta(days=1)
    prompts = spark.createDataFrame([("p", "A dog.", ["dog"], [], None, 1), ("p", "A dog.", ["dog"], [], None, 2), (None, "x", None, None, None, 3)], "id string, summary string, words array<string>, features array<string>, sentence string, story long")
    rows = [("r", "p", 1, "N/A", now, "x"), ("r", "p", 1, "N/A", later, "y"), ("r", "p", 2, "The dog slept.", now, None), ("r", "q", 3, None, now, None), (None, "p", None, None, None, None), ("r", None, 1, None, now, None)]
    samples = spark.createDataFrame(rows, "run_id string, id string, sample int, story string, loaded_at timestamp, summary string")
    got = {(r.run_id, r.id, r["sample"]): r.defect for r in P.judged_pairs(samples, prompts).collect()}
    assert got == {("r", "p", 1): "empty", ("r", "p", 2): None, (None, "p", None): "empty"}
    assert P.judged_pairs(samples.limit(0), prompts.limit(0)).count() == 0
    for hot in (1, 1000):
        assert {(r.run_id, r.id, r["sample"]): r.defect for r in P.judged_pairs(samples, prompts, small=0, hot=hot).collect()} == got
