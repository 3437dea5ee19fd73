"""Text scalar functions as columns. White space, word characters and word borders are those of Unicode throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What parts words, and what is a word character, as classes of regular expressions.
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
#: The punctuation that a comparison of answers disregards.
PUNCTUATION = r"[!-/:-@\[-`{-~]"
#: Evaluation sets of the question and the summary kind, and the prompts for those without a question.
QUESTION_SETS = ("qasper", "2wikimqa", "multifieldqa_en", "hotpotqa", "triviaqa", "narrativeqa", "musique")
SUMMARY_SETS = ("gov_report", "qmsum", "multi_news", "vcsum")
SUMMARY_PROMPT = "Please provide a concise summary of the document above.\nSummary:"
OTHER_PROMPT = "Respond based on the context above.\n"
#: Short names of models.
MODEL_ALIASES = {
    "qwen2.5-0.5b": "Qwen/Qwen2.5-0.5B-Instruct",
    "qwen2.5-1.5b": "Qwen/Qwen2.5-1.5B-Instruct",
    "qwen2.5-3b": "Qwen/Qwen2.5-3B-Instruct",
    "qwen2.5-7b": "Qwen/Qwen2.5-7B-Instruct",
    "qwen2.5-14b": "Qwen/Qwen2.5-14B-Instruct",
    "llama3.2-1b": "meta-llama/Llama-3.2-1B-Instruct",
    "llama3.2-3b": "meta-llama/Llama-3.2-3B-Instruct",
    "llama3.1-8b": "meta-llama/Llama-3.1-8B-Instruct",
    "mistral-7b": "mistralai/Mistral-7B-Instruct-v0.3",
    "phi3-mini": "microsoft/Phi-3-mini-4k-instruct",
    "gemma2-2b": "google/gemma-2-2b-it",
    "gemma2-9b": "google/gemma-2-9b-it",
}
_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def words(text: Column) -> Column:
    """The words between white space; none for a blank text."""
    return F.filter(F.split(text, rf"{SPACE}+"), lambda w: w != "")


def chunk_count(n: Column, size: int, overlap: int) -> Column:
    """The number of fixed chunks of a text of n words."""
    step = max(1, size - overlap)
    return F.when(n <= 0, 0).when(n <= size, 1).otherwise((F.ceil((n - size) / F.lit(step)) + 1).cast("int")).cast("int")


def windows(w: Column, size: int, overlap: int) -> Column:
    """Windows of `size` words of an array, each beginning `overlap` words (at most all but one) before the end of the one
    before; the last is the first that reaches the end. Give a column, not an expression, which would be evaluated anew
    for every window."""
    if size < 1 or overlap < 0:
        raise ValueError("need size >= 1 and overlap >= 0")
    step = max(1, size - overlap)
    n = chunk_count(F.size(w), size, overlap)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: F.array_join(F.slice(w, k * step + 1, F.lit(size)), " "))


def fixed_chunks(text: Column, size: int, overlap: int) -> Column:
    """The windows of a text's words; `corpus.chunked` is the way for whole tables."""
    return windows(words(text), size, overlap)


def safe_stem(name: Column) -> Column:
    """The first 64 characters, with all but word characters and hyphens turned to underscores."""
    return F.left(F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "_"), F.lit(64))


def chunk_id(base: Column, index: Column, total: Column) -> Column:
    """A chunk's id: the stem, with the chunk's number where there are several."""
    return F.when(total == 1, safe_stem(base)).otherwise(F.concat(safe_stem(base), F.lit("_c"), F.format_string("%03d", index)))


def content_hash(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(16))


def store_key(doc_id: Column, layer: Column, scheme: Column) -> Column:
    """The name of a stored entry."""
    return F.concat(F.left(F.sha2(doc_id, 256), F.lit(16)), F.format_string("_L%02d_", layer), scheme)


def normalise_answer(text: Column) -> Column:
    """Lower case, articles away, punctuation to blanks, single blanks; in this order."""
    bare = F.regexp_replace(F.lower(text), rf"(?<!{WORD})(?:a|an|the)(?!{WORD})", " ")
    return F.array_join(words(F.regexp_replace(bare, PUNCTUATION, " ")), " ")


def answer_tokens(text: Column) -> Column:
    return words(normalise_answer(text))


def extract_query(prompt: Column, dataset: Column) -> Column:
    """What a prompt asks, without the document. Question sets: what stands between the last `Question:` line and
    `Answer:`, else the last line that is not blank. Summary sets: SUMMARY_PROMPT. Others, and question sets without a
    line: the last paragraph, else OTHER_PROMPT."""
    tail = strip(F.substring_index(prompt, "\nQuestion:", -1))
    asked = F.concat(F.lit("Question: "), strip(F.substring_index(tail, "\nAnswer:", 1)), F.lit("\nAnswer:"))
    filled = lambda xs: F.filter(F.transform(xs, strip), lambda x: x != "")
    last = lambda xs, end: F.concat(F.try_element_at(filled(xs), F.lit(-1)), F.lit(end))
    line, paragraph = last(F.split(strip(prompt), _LINE_END), "\nAnswer:"), last(F.split(prompt, "\n\n"), "\n")
    other = F.coalesce(paragraph, F.lit(OTHER_PROMPT))
    return (
        F.when(dataset.isin(*QUESTION_SETS), F.when(F.instr(prompt, "\nQuestion:") > 0, asked).otherwise(F.coalesce(line, other)))
        .when(dataset.isin(*SUMMARY_SETS), F.lit(SUMMARY_PROMPT))
        .otherwise(other)
    )


def truncated(text: Column, most: int) -> Column:
    """The first `most` words."""
    return F.array_join(F.slice(words(text), 1, most), " ")


def holds_answer(answer: Column, reference: Column) -> Column:
    """Whether the reference stands in the answer, case and outer white space aside; an empty reference does."""
    return F.contains(F.lower(strip(answer)), F.lower(strip(reference)))


def build_prompt(question: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit("\nAnswer:"))


def parse_schemes(text: str) -> list[str]:
    """Names between commas, trimmed; empty ones are left out."""
    return [x.strip() for x in text.split(",") if x.strip()]


def resolve_alias(name: str, aliases: dict[str, str]) -> str:
    """A short name's long one, whatever its case; other names stand for themselves."""
    return aliases.get(name.lower(), name)
