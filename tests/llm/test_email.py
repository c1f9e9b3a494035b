from __future__ import annotations

import pytest

from traceloom.llm.email import label_lines, new_lines

HEAD = "From: Ana Berg | Date: 2024-01-02 | Subject: Re: x\n\n"


def new(body, head=HEAD):
    text = head + body
    lines = text.split("\n")
    return [lines[i].strip() for i, label in label_lines(text) if label == "new"]


def test_quotes_with_replies_between():
    body = "Hi Bo,\n\nOn Mon, 1 Jan 2024, Bo Rask wrote:\n> first question?\nMy answer.\n> second\n>\n> third\n\nAnother answer.\n\nBest,\nAna"
    assert new(body) == ["Hi Bo,", "My answer.", "Another answer."]


def test_attributions_in_several_languages_and_over_two_lines():
    for line in ("Am 01.01.2024 10:00 schrieb Bo Rask <bo@x.y>:", "El 2024-01-01 10:00, Bo Rask escribió:", "Le 1 janv. 2024, Bo Rask a écrit :", "Bo Rask wrote on 2024-01-01:", "Quoting Bo Rask <bo@x.y>:", "On 2024-01-01 10:00,\nBo Rask <bo@x.y> wrote:"):
        assert new(f"Text.\n\n{line}\n> old") == ["Text."], line


def test_forwarded_mail_ends_the_new_text():
    for opening in ("---------- Forwarded message ----------", "Begin forwarded message:", "Anfang der weitergeleiteten Nachricht:", "-----Message d'origine-----", "==== earlier mail ===="):
        assert new(f"See below.\n\n{opening}\nFrom: Bo\nSent: Monday\nTo: Ana\n\nOld text.") == ["See below."], opening
    assert new("Text.\n\n________\n*Von:* Bo\n*Gesendet:* gestern\n*An:* Ana\n*Betreff:* x\n\nAlter Text.") == ["Text."]


def test_signature_and_postscript():
    body = "Text.\n\nMit freundlichen Grüßen\n--\nAna Berg\nTest Lead, Works GmbH\nT: +00 30 555\nana@x.y\n\nP.S. One more thing."
    assert new(body) == ["Text.", "P.S. One more thing."]
    assert new("Text.\n\nAna") == ["Text."]
    assert new("Thanks, that solved it for me.\nBest, in my view, is option 3.\n\nCheers,\nAna") == ["Thanks, that solved it for me.", "Best, in my view, is option 3."]


def test_banner_device_and_legal_text():
    body = "CAUTION: unknown sender domain.\n\nText.\n\nSent from my phone\n\nThis e-mail and its attachments may contain confidential information for the\nnamed recipient only.\n"
    assert new(body) == ["Text."]
    assert new("The reply type is confidential in R9 and must be masked.") == ["The reply type is confidential in R9 and must be masked."]


def test_context_block_line_numbers_and_line_ends():
    text = "[Previous context:]\nFrom: Bo | Date: x | Subject: y\n\nold\n[End context]\n\n" + HEAD + "New one.\r\n\r\n1. list\r\n"
    assert [i for i, label in label_lines(text) if label == "new"] == [8, 10]


def test_wrapped_quote_lines():
    body = "> a long quoted sentence that a mail program wrapped in the middle of the\nline\n> and went on\n\nNew text here."
    assert new(body) == ["New text here."]


def test_no_header_and_table(spark):
    assert new("Just text.", head="") == ["Just text."]
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, " \n ", "c"), (4, HEAD + "Hi.", "d"), (4, HEAD + "Hi.", "d")], "k long, chunk_text string, label string")
    assert sorted((r.k, r.line_no) for r in new_lines(df, "k").collect()) == [(4, 2), (4, 2)]
    assert new_lines(df.limit(0), "k").collect() == []


def test_long_texts_are_quick():
    label_lines(HEAD + "--\n" * 20_000 + "> q\n" * 20_000 + "Thanks\ntext\n" * 20_000)


def test_signs_that_are_no_quotes():
    body = "It takes long.\n> 56 minutes of waiting is too much.\n\n>>> load(3) then prints None.\nWhy?\n\nOn Mon, 1 Jan 2024, Bo wrote:\n> 5 days are fine.\n\n> Old.\n> 7 hours more."
    assert new(body) == ["It takes long.", "> 56 minutes of waiting is too much.", ">>> load(3) then prints None.", "Why?"]


@pytest.mark.parametrize(
    "body",
    [
        "This message is about the release plan.\nIt must ship on Friday.",
        "This email contains the numbers you asked for.\nThey are final.",
        "Warning: the link on page 3 is dead.\nPlease fix it.",
        "External tools are listed below.\nAsk me for more.",
        "This communication has improved a lot.",
        "The information in this chapter is old.",
    ],
)
def test_plain_sentences_are_no_notices(body):
    assert new(body) == body.split("\n")


@pytest.mark.parametrize("notice", ["This e-mail may contain private information.", "This message is intended for its addressee only.", "This email and any attachments are confidential.", "This message has been scanned for viruses.", "[EXTERNAL] This mail was sent from outside.", "CAUTION: unknown sender domain.", "Achtung: diese E-Mail stammt von einer externen Adresse."])
def test_notices_are_not_new(notice):
    assert new(f"Please send it.\n\n{notice}") == ["Please send it."]


@pytest.mark.parametrize("introduction", ["在 2024年5月3日，王伟 写道：", "王伟 写道：", "Il giorno 3 maggio 2024 Anna Rossi ha scritto:", "Escribió Bo:", "Anna Rossi wrote:", "Em 3 de maio de 2024, Ana escreveu:", "On Mon, 3 May 2024, " + "Anna Maria Rossi <a@b.c>, " * 15 + "wrote:"])
def test_introductions_of_many_languages(introduction):
    assert new(f"Yes, agreed.\n\n{introduction}\n> old text\n\nMore below.") == ["Yes, agreed.", "More below."]


def test_replies_below_an_older_mail_stay_new():
    block = "-----Original Message-----\nFrom: A\nSent: today\nSubject: x\n\n> old one\n> old two\n\nI answer down here."
    assert new(block) == ["I answer down here."]
    assert new("Above.\n---------- Forwarded message ----------\nFrom: A\n\nold\n\n---- End of forwarded message ----\nBelow.") == ["Above.", "Below."]
    assert new("Above.\n-----Original Message-----\nFrom: A\nSubject: x\n\nall old\nto the end") == ["Above."]
