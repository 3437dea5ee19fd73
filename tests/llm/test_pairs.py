import pytest

from kvlake.llm import pairs

EN = "Which page size does the Xanmbi-28 loader report under load?"
FR = "Quelle valeur Wubpsa-80 donne-t-il pour la couche 9 quand la réserve est pleine ?"
CASES = [
    (EN, None, "empty"), (EN, "", "empty"), (EN, " 　\n", "empty"), (EN, "```\n```", "empty"), (EN, "—", "empty"),
    (EN, "I'm sorry, but I can’t help with that.", "refusal"), (EN, "No comment on Xanmbi-28 from my side; please ask somebody else.", "refusal"),
    (EN, "Let's talk about something other than Xanmbi-28.", "refusal"), (FR, "Désolé, je préfère ne pas donner de réponse ici.", "refusal"),
    (EN, "The call prints “I'm sorry, I can't map this page” and then returns 28 bits.", None), (EN, "The loader declines to evict the page and cannot hold 4 slots.", None),
    (EN, EN, "copy"), (EN, f"> {EN.upper()}", "copy"), (EN, f"{EN}\n{EN}", "copy"), (EN, f"The question is: {EN}", "copy"), (FR, FR.replace(" ?", ""), "copy"),
    (EN, f"{EN} The text answers this with 28 bits.", None), (EN, "Xanmbi-28 uses 28 bits here.", None),
    (EN, "Der Lader begrenzt die Kopfzeilen von Hobor nach 500 Schritten.", "language"), (EN, "O carregador completa a camada comum.", "language"),
    (EN, "加载器复用最大的文档，位于第17层。", "language"), (FR, "Le chargeur libère la couche partagée pendant la nuit.", None), (FR, "500 µs", None), (FR, "every 16 tokens per page", None),
    (EN, "It is 28 bits. The loader falls back to the", "truncated"), (EN, "It is 28 bits. The loader reports,", "truncated"), (EN, "See:\n```\nx = load(page)  # done.", "truncated"),
    (EN, "1. The first step ends.\n2. The second step", "truncated"), (EN, "See:\n```\nx = 1\n```", None), (EN, "- the warm loader\n* page pool 7", None), (EN, "28 bits", None), (EN, "28 bits per page.", None),
]


@pytest.mark.parametrize(("prompt", "answer", "want"), CASES)
def test_defects(prompt, answer, want):
    assert pairs.defect(answer, pairs.Prompt(prompt)) == want


def test_rows(spark):
    rows = [(i, p, a, 3, 64) for i, (p, a, _) in enumerate(CASES)] * 2 + [(900, "none", EN, None, None), (None, EN, "", 0, 64), (901, None, "", 0, 64)]
    runs = spark.createDataFrame(rows, "run_id int, doc_id string, answer string, num_output_tokens int, max_new_tokens int").withColumnRenamed("doc_id", "doc_id")
    prompts = spark.createDataFrame([(EN, EN), (FR, FR), (EN, EN), (None, "x")], "doc_id string, query_prompt string")
    got = {r.run_id: r.defect for r in pairs.broken_pairs(runs, prompts).collect()}
    assert got == {i: d for i, (_, _, d) in enumerate(CASES) if d} | {None: "empty", 901: "empty"}
    assert pairs.broken_pairs(runs.limit(0), prompts).count() == 0


def test_very_long_answer():
    assert pairs.defect("The loader holds it. " * 50_000, pairs.Prompt(EN)) is None


def test_foreign_answer_that_quotes_the_question():
    for answer in ("加载器在“ the page and the loader ”的情况下复用最大的文档，位于第17层，并且会继续处理后面的所有请求。", "Загрузчик страниц при условии “ the page and the loader ” переписывает самые старые блоки и затем продолжает работу."):
        assert pairs.defect(answer, pairs.Prompt(EN)) == "language"


#: Ordinary sentences in the first person, or with the words of refusals, that answer all the same.
PLAIN = """
That is what I am measuring in the run: 28 bits.
The notes list what I can confirm: the page size is 28 bits.
I don't know of any larger page, the loader reports 28 bits.
My guidelines document gives 28 bits per page.
I can't see a larger page than 28 bits in the trace.
I could not find a smaller one, so it is 28 bits.
My loader cannot hold more than 28 bits.
I have no idea why, but the value is 28 bits.
I will not go into rounding: it is 28 bits.
The answer cannot be cached, it is 28 bits.
As far as I may judge from the log, 28 bits.
It goes beyond what I measured before, 28 bits.
There is no comment on line 5, the default is 28 bits.
The scheduler refuses to answer after 28 bits.
We decline larger pages; the limit is 28 bits.
I was not able to load more than 28 bits.
Ask the loader: it reports 28 bits.
Ich kann den Wert ablesen: 28 Bit.
Der Lader kann nicht mehr als 28 Bit halten.
Je ne peux pas charger plus de 28 bits.
No puedo cargar más de 28 bits.
Non posso caricare più di 28 bit.
Ik kan niet meer dan 28 bits laden.
Я не могу загрузить больше 28 бит.
""".strip().split("\n")
DECLINED = """
I'm sorry, I can't say.
I don't know.
I do not know the answer to that.
No comment.
My instructions do not allow answering this.
That is outside of what I can discuss.
I refuse to answer.
Leider kann ich dazu keine Auskunft geben.
Non posso rispondere a questa domanda.
Mi dispiace, non sono in grado di fornire questi dettagli.
Helaas kan ik deze vraag niet beantwoorden.
Ik moet weigeren.
Não posso responder a esta pergunta.
Я не могу ответить на этот вопрос.
申し訳ありませんが、その質問にはお答えできません。
抱歉，我无法回答这个问题。
""".strip().split("\n")


def test_ordinary_sentences_are_no_refusals():
    assert [x for x in PLAIN if pairs.is_refusal(x)] == []
    assert [x for x in DECLINED if not pairs.is_refusal(x)] == []
