"""The lines newly written by the sender of a mail.

Multilingual line rules label every line: context block, header, banner, attribution, quote,
forwarded header and what follows it, closing formula, signature, device note, legal text, or new.
Replies written between quoted lines stay new.

Defined results: lines end at line feeds and are numbered from 0 over the whole text; a text
without header line is read as a body whose sender is unknown; null and blank texts have no lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADER = re.compile(r"^From:\s*(?P<sender>.*?)\s*\|\s*Date:.*?\|\s*Subject:")
_QUOTE = re.compile(r"^\s*(?:>|»|\||›|&gt;)")

LONG_INTRODUCTION = 260  # beyond this many characters an introduction must open with its date

# Signs that look like a quote mark: "more than" before a number with its unit, and the prompt of a Python shell.
_NO_QUOTE = re.compile(
    r"^\s*>\s?[~≈]?\d[\d.,]*\s*(?:%|(?:percent|seconds?|minutes?|hours?|days?|weeks?|months?|years?|ms|[kmg]b|rows?|users?|times|points?|prozent|sekunden?|minuten?|stunden?|tagen?|wochen?|monaten?|pour cent|secondes?|heures?|jours?|semaines?|mois|por ciento|segundos?|minutos?|horas?|días?|semanas?|meses)\b)"
    r"|^\s*>>>\s+(?:[\w.]+\(|import\s|from\s|[\w.]+\s*=|print\b|for\s|with\s|assert\s)",
    re.I,
)

# The line rules, by language where they differ.
_BANNER = re.compile(
    r"^\W*(?:\[(?:external|extern|externe|externo)\].*|(?:external|externe?s?|externo)\s+(?:e-?mail|mail|message|sender|absender|courriel|correo|remitente)\b[^.!?]{0,40}[.!]?\s*$|(?:external|extern|externe|externo)\W*$"
    r"|(?:caution|warning|achtung|vorsicht|attention|avertissement|atención|advertencia|precaución)\b\s*[:!].*(?:unknown (?:sender|domain)|sender domain|external|outside|extern|unbekannte|inconnu|desconocid|expéditeur|remitente|do not (?:open|click|follow) (?:any )?links?).*)$",
    re.I,
)
_BANNER_MORE = re.compile(r"\b(?:extern\w*|outside|unknown sender|sender domain|do not open|öffnen sie|n'ouvrez|no abra|links?)\b", re.I)
_WROTE = re.compile(
    r"(?:\b(?:wrote|writes|said|says)(?:\s+on\b[^\n]*)?|\bschrieb\b.*|\ba écrit\s*|\bescribió\b.*|\bha scritto\b.*|\bescreveu\b.*|\bschreef\b.*)\s*:\s*$|(?:写道|寫道|写到|来信说)\s*[:：]\s*$",
    re.I,
)
_OPENS = re.compile(r"^\s*(?:(?:on|at|am|le|el|den|il|em|op)\s|在|于|於|\d{4}\s*年)", re.I)
_VERB = re.compile(r"\b(?:wrote|said|schrieb|a écrit|escribió|ha scritto|escreveu|schreef)\b|写道|寫道|写到|来信说", re.I)
_BARE = re.compile(r"^(?:escribió|schrieb)\s+[^\W\d_][^:.!?]{0,40}:\s*$|^[^\W\d_][^:.!?,;]{0,40}\s(?:wrote|schrieb|a écrit|escribió|ha scritto|escreveu|schreef)\s*:\s*$|^[^\s:：，。]{1,20}\s*(?:写道|寫道)\s*[:：]\s*$", re.I)  # without a date; a quote must follow
_QUOTING = re.compile(r"^\s*(?:quoting|zitat von|citando a|citation de)\b.*:\s*$", re.I)
_DATED = re.compile(r"\d{1,4}[-./ 年月]\w*[-./ ]*\d*|\d{4}", re.I)
_FORWARD = re.compile(
    r"^\s*(?:[-=_*]{2,}\s*)?(?:(?:begin\s+)?forwarded message|original message|original mail|ursprüngliche nachricht|originalnachricht|weitergeleitete nachricht|mensaje original|mensaje reenviado|message d['’]origine|message original|message transféré|message forwardé|earlier mail|previous mail|begin forwarded message|anfang der weitergeleiteten nachricht|début du message (?:transféré|réexpédié)|inicio del mensaje reenviado|forwarded by\b.*?|weitergeleitet von\b.*?|transféré par\b.*?|reenviado por\b.*?)\s*:?\s*(?:[-=_*]{2,})?\s*$",
    re.I,
)
_FORWARD_END = re.compile(r"^\s*[-=_*]{2,}\s*(?:end (?:of )?(?:the )?(?:forwarded|original|quoted)? ?(?:message|mail)|ende der (?:weitergeleiteten |ursprünglichen )?nachricht|fin du message(?: transféré)?|fin del mensaje(?: reenviado)?)\s*[-=_*]*\s*$", re.I)
_FIELD = re.compile(r"^\s*\*{0,2}(?:from|sent|to|cc|bcc|date|subject|von|gesendet|an|kopie|betreff|datum|de|envoyé|à|objet|date|enviado(?: el)?|para|asunto|fecha|reply-to)\s*:\*{0,2}(?:\s|$)", re.I)
_FROM_FIELD = re.compile(r"^\s*\*{0,2}(?:from|von|de)\s*:\*{0,2}\s+\S", re.I)
_RULE = re.compile(r"^\s*(?:[-–—_=*#~]{2,}|(?:[-*_#] ){2,}[-*_#]|—|–|\*\s\*\s\*)\s*$")
_CLOSING = re.compile(
    r"^\s*(?:(?:many\s+|with\s+many\s+)?thanks(?:\s+(?:a lot|again|in advance|so much|and (?:best|kind|warm)?\s*(?:wishes|regards)))?|many thanks and best wishes|thank you(?: (?:very much|in advance|again))?|thx|cheers|best|all the best|best (?:regards|wishes)|kind(?:est)? regards|warm(?:est)? regards|regards|with (?:best|kind) (?:regards|wishes)|yours(?: (?:sincerely|faithfully|truly))?|sincerely(?: yours)?|br|rgds|take care|talk soon|have a (?:nice|good) (?:day|weekend|evening)"
    r"|(?:mit )?(?:freundlichen|besten|herzlichen|vielen|lieben) (?:grüßen|gruß|grüssen|dank)|(?:viele|beste|liebe|herzliche|schöne|freundliche) (?:grüße|grüsse)|(?:vielen )?dank und (?:gruß|grüße|viele grüße)|danke und (?:gruß|viele grüße|grüße)|besten dank|vielen dank|danke(?: im voraus)?|gruß|grüße|lg|vg|mfg|hg"
    r"|cordialement|bien (?:à vous|cordialement|à toi)|bonne (?:journée|soirée|continuation|fin de journée)|(?:très )?cordialement|amicalement|merci(?: d['’]avance| beaucoup| et (?:bonne journée|cordialement|à bientôt))?|(?:meilleures )?salutations(?: distinguées)?|à bientôt|sincères salutations|bien amicalement"
    r"|(?:un )?(?:cordial )?saludos?(?: cordiales?)?|gracias(?: y (?:un )?saludos?| de antemano| por todo)?|(?:muchas )?gracias|atentamente|un abrazo|abrazos|saludos cordiales|hasta (?:pronto|luego)|quedo atent[oa])\s*[,.!–—-]*\s*$",
    re.I,
)
_DEVICE = re.compile(
    r"^\W*(?:sent from (?:my|mail|outlook|yahoo|a)\b.*|get (?:the|outlook|our)\b.*\b(?:app|for (?:ios|android))\b.*|von (?:meine[mr]|unterwegs)\b.*\b(?:gesendet|geschickt)\b.*|gesendet von\b.*|unterwegs getippt\b.*|envoyé (?:de|depuis)\b.*|enviado (?:desde|de)\b.*|typed on (?:my|a)\b.*|written on (?:my|a)\b.*phone.*|sent on the go.*|sent via\b.*)$",
    re.I,
)
_LEGAL = re.compile(
    r"^\W*(?:confidential(?:ity)?(?: notice| note)?\s*:|confidentiality notice\b|this (?:e-?mail|message|communication|transmission)\b[^.]*\b(?:confidential|privileged|intended)|this (?:e-?mail|message|communication)(?: and (?:its|any) (?:attachments?|files?))?\s+(?:(?:is|are) (?:private|proprietary|strictly|solely|only for|for the (?:sole|exclusive|named|use)|meant (?:only|solely|for)|subject to|protected|legally|property)\b|may (?:contain|be)\b.*\b(?:information|private|protected|copyright|privilege\w*|proprietary|monitored)|contains? (?:private|proprietary|legally|copyright|information (?:that|which|intended|belonging)|trade secrets?)\b|has been (?:scanned|checked|swept)\b)|the information (?:above|contained|in this (?:e-?mail|message|communication|transmission))\b.*\b(?:confidential|private|privileged|intended|proprietary|addressee|recipient|legal\w*)|please consider the environment\b|any unauthori[sz]ed (?:review|use|disclosure)|if you (?:are not the|have received this|got (?:it|this))\b.*(?:recipient|addressee|mistake|error)|views expressed are those|disclaimer\s*:|legal notice\s*:"
    r"|[^.!?]{0,60}\baccepts? no liability\b|registered office\s*:|[^.!?]{0,60}\bsitz der gesellschaft"
    r"|diese (?:nachricht|e-?mail)\b[^.]*\b(?:vertraulich|ausschließlich|nur für)|der inhalt dieser (?:e-?mail|nachricht)\b|(?:bitte )?(?:denken|prüfen) sie\b.*\b(?:umwelt|drucken)|sollten sie\b.*\birrtümlich\b|haftungsausschluss\s*:|vertraulichkeitshinweis\s*:"
    r"|ce (?:message|courriel|mail)\b[^.]*\b(?:confidentiel|destiné|strictement)|(?:le|les) (?:contenu|informations?)\b[^.]*\b(?:de ce (?:message|courriel)|confidentiel)|pensez à l['’]environnement|avis de confidentialité|si vous (?:avez reçu|n['’]êtes pas)\b.*(?:erreur|destinataire)"
    r"|este (?:mensaje|correo)\b[^.]*\b(?:confidencial|dirigid|exclusiv|destinatari)|la información (?:contenida|de este)\b|aviso (?:legal|de confidencialidad)|si (?:usted )?(?:ha recibido|no es)\b.*(?:error|destinatario)|antes de imprimir|[^.!?]{0,60}\b(?:décline toute responsabilité|n['’]accepte aucune responsabilité|no (?:responde|se hace responsable|acepta (?:ninguna )?responsabilidad)|haftet nicht|übernimmt keine (?:haftung|verantwortung)))",
    re.I,
)
_POSTSCRIPT = re.compile(r"^\s*(?:p\.?\s?p?\.?\s?s\.?|n\.?\s?b\.?|post scriptum|posdata|pd|p\.\s?d\.)\s*[:.)–-]", re.I)
_CONTACT = re.compile(
    r"(?:\b(?:t|tel|phone|mobile|mob|fon|telefon|tél|fax|f|m)\s*[:.]\s*\+?\d|\+\d{1,3}[ \d()/-]{5,}|\S+@\S+\.\w+|\bwww\.|https?://|\bmy working days\b|\b(?:street|straße|strasse|str\.|avenue|rue|calle|platz|road)\b\s*\d*\s*$|\broom\s+\d+|\b(?:gmbh|sarl|ltd|inc|llc|s\.?a\.?|y asociados|institute|labs|systems|works|group|university|universität|université|universidad)\b\s*(?:\||$)"
    r"|^(?:\w+\s){0,3}(?:engineer|analyst|lead|owner|assistant|manager|developer|architect|director|head of \w+|consultant|officer|scientist|professor|développeu[rs]e?|ingénieure?|arquitect[oa](?: de software)?|dozent(?:in)?|projektleit(?:ung|er|erin)|entwickler(?:in)?|leiter(?:in)?|student(?:in)?|desarrollador(?:a)?|profesor(?:a)?|chef(?:fe)? de projet)\b)",
    re.I,
)
_SENTENCE_END = re.compile(r"[.!?:;…]['\"»”)\]]*\s*$")


def _names(sender: str) -> set[str]:
    return {w for w in re.findall(r"[^\W\d_]+", sender.casefold()) if len(w) > 1}


def _names_sender(line: str, names: set[str]) -> bool:
    """A line that consists of the sender's name (first, last, or initials with it) and perhaps a title."""
    words = re.findall(r"[^\W\d_]+", line.casefold())
    return bool(names) and 0 < len(words) <= 4 and any(w in names for w in words) and all(w in names or len(w) == 1 or w in ("dr", "prof", "dipl", "ing") for w in words)


def label_lines(text: str) -> list[tuple[int, str]]:
    """(line number, label) of every line that is not blank."""
    lines = [x.rstrip("\r") for x in text.split("\n")]
    n = len(lines)
    labels: list[str | None] = [None] * n
    blank = [not x.strip() for x in lines]
    i = 0
    while i < n and blank[i]:
        i += 1
    if i < n and lines[i].strip().lower().startswith("[previous context"):
        end = next((j for j in range(i, n) if lines[j].strip().lower() == "[end context]"), None)
        stop = (end + 1) if end is not None else n
        for j in range(i, stop):
            labels[j] = "context"
        i = stop
    while i < n and blank[i]:
        i += 1
    sender = ""
    if i < n and (m := HEADER.match(lines[i].strip())):
        sender = m["sender"]
        labels[i] = "header"
        i += 1
    body = i
    names = _names(sender)

    # quotes and what belongs to them
    for j in range(body, n):
        if not blank[j] and _QUOTE.match(lines[j]):
            labels[j] = "quote"
    _attributions(lines, blank, labels, body)
    _no_quotes(lines, blank, labels, body)
    _broken_quotes(lines, blank, labels, body)
    _forwards(lines, blank, labels, body)
    _banners(lines, blank, labels, body)
    _notes(lines, blank, labels, body)
    _signatures(lines, blank, labels, body, names)
    return [(j, labels[j] or "new") for j in range(n) if not blank[j]]


def _attributions(lines: list[str], blank: list[bool], labels: list[str | None], body: int) -> None:
    """Introductions of quotes, on one line or broken over up to three."""
    n = len(lines)
    for j in range(body, n):
        if blank[j] or labels[j]:
            continue
        line = lines[j].strip()
        if _QUOTING.match(line):
            labels[j] = "attribution"
            continue
        if _BARE.match(line) and (follows := next((m for m in range(j + 1, n) if not blank[m]), None)) is not None and labels[follows] == "quote":
            labels[j] = "attribution"
            continue
        opens = _OPENS.match(line) and _DATED.search(line) or _VERB.search(line)
        for k in range(j, min(j + 3, n)) if opens else ():
            if blank[k] or labels[k]:
                break
            joined = " ".join(x.strip() for x in lines[j : k + 1])
            if _WROTE.search(joined) and _DATED.search(joined) and (len(joined) < LONG_INTRODUCTION or _OPENS.match(joined)):
                follows = next((m for m in range(k + 1, n) if not blank[m]), None)
                if follows is None or labels[follows] == "quote" or "@" in joined or k > j or _OPENS.match(joined):
                    for m in range(j, k + 1):
                        labels[m] = "attribution"
                break


def _no_quotes(lines: list[str], blank: list[bool], labels: list[str | None], body: int) -> None:
    """Lines that begin with a sign like a quote mark, stand apart from quoted lines and are not introduced as a quote."""
    j, before = body, None
    while j < len(lines):
        if labels[j] != "quote":
            before = before if blank[j] else labels[j]
            j += 1
            continue
        end = j
        while end < len(lines) and labels[end] == "quote":
            end += 1
        if before != "attribution" and all(_NO_QUOTE.match(x) for x in lines[j:end]):
            labels[j:end] = [None] * (end - j)
            before = None
        else:
            before = "quote"
        j = end


def _broken_quotes(lines: list[str], blank: list[bool], labels: list[str | None], body: int) -> None:
    """The rest of a quoted line that a mail program wrapped without repeating the prefix."""
    for j in range(body + 1, len(lines)):
        if blank[j] or labels[j] or labels[j - 1] != "quote":
            continue
        before = re.sub(r"^[\s>»|›]+", "", lines[j - 1]).strip()
        here = lines[j].strip()
        if not before or _SENTENCE_END.search(before) or before.endswith(","):
            continue
        alone = j + 1 >= len(lines) or blank[j + 1] or labels[j + 1] == "quote"
        goes_on = here[:1].islower() and not re.match(r"\w+(?:_\w+|\(\))", here)
        if len(before) >= 40 and alone and (len(here) <= 30 or goes_on):
            labels[j] = "quote"


def _forwards(lines: list[str], blank: list[bool], labels: list[str | None], body: int) -> None:
    """From the introduction of a forwarded mail (or its bare header block) to the end everything is older."""
    n = len(lines)
    for j in range(body, n):
        if blank[j] or labels[j] in ("quote", "forwarded"):
            continue
        opens = bool(_FORWARD.match(lines[j]))
        if not opens and _FROM_FIELD.match(lines[j]):
            fields = 0
            for k in range(j, min(j + 7, n)):
                if _FIELD.match(lines[k]):
                    fields += 1
                elif not blank[k]:
                    break
            opens = fields >= 3
        if opens:
            first = j
            above = [k for k in range(max(body, j - 2), j) if not blank[k]]
            if above and _RULE.match(lines[above[-1]]) and labels[above[-1]] is None:
                first = above[-1]
            end = _forward_end(lines, blank, labels, j, n)
            for k in range(first, end):
                if not blank[k]:
                    labels[k] = "forwarded"
            if end == n:
                return


def _forward_end(lines: list[str], blank: list[bool], labels: list[str | None], at: int, n: int) -> int:
    """Where the older mail that begins at ``at`` ends: after its last marked line if its text is quoted by marks, after a line that says so, else with the text."""
    for k in range(at + 1, n):
        if _FORWARD_END.match(lines[k]):
            return k + 1
    k = at + 1
    while k < n and (blank[k] or _FIELD.match(lines[k]) or _RULE.match(lines[k])):
        k += 1
    if k < n and labels[k] == "quote":
        while k < n and (blank[k] or labels[k] == "quote"):
            k += 1
        while k < n and blank[k - 1]:
            k -= 1
        return k
    return n


def _banners(lines: list[str], blank: list[bool], labels: list[str | None], body: int) -> None:
    for j in range(body, len(lines)):
        if blank[j] or labels[j]:
            continue
        if _BANNER.match(lines[j]):
            k = j
            while k < len(lines) and not blank[k] and labels[k] is None and (k == j or _BANNER_MORE.search(lines[k])):
                labels[k] = "banner"
                k += 1


def _notes(lines: list[str], blank: list[bool], labels: list[str | None], body: int) -> None:
    """Device notes, and legal paragraphs up to the next blank line."""
    n = len(lines)
    for j in range(body, n):
        if blank[j] or labels[j]:
            continue
        opens = j == body or blank[j - 1] or labels[j - 1] is not None or bool(_RULE.match(lines[j - 1]))
        if _DEVICE.match(lines[j]):
            labels[j] = "device"
        elif _LEGAL.match(lines[j]) or opens and _LEGAL.match(" ".join(x.strip() for x in lines[j : j + 2])):
            k = j
            while k < n and not blank[k] and labels[k] is None:
                labels[k] = "legal"
                k += 1


def _signatures(lines: list[str], blank: list[bool], labels: list[str | None], body: int, names: set[str]) -> None:
    """Closing formulas and what follows them, up to a postscript or new text."""
    n = len(lines)
    j = body
    while j < n:
        if blank[j] or labels[j]:
            j += 1
            continue
        line = lines[j].strip()
        closing = bool(_CLOSING.match(line))
        rule = bool(_RULE.match(line))
        named = _names_sender(line, names)
        if closing or rule or named:
            nxt = next((k for k in range(j + 1, n) if not blank[k]), None)
            if named and not _tail(lines, blank, labels, j, names):
                j += 1
                continue
            if (closing or rule) and not (nxt is None or labels[nxt] or _names_sender(lines[nxt].strip(), names) or _RULE.match(lines[nxt]) or _CLOSING.match(lines[nxt].strip()) or _signature_line(lines[nxt], names)):
                if rule:
                    labels[j] = "signature" if nxt is None else labels[j]
                    j += 1
                    continue
                if not _tail(lines, blank, labels, j, names):
                    j += 1
                    continue
            labels[j] = "signature"
            k = j + 1
            while k < n:
                if blank[k]:
                    k += 1
                    continue
                if labels[k] in ("legal", "device"):
                    k += 1
                    continue
                if labels[k] or _POSTSCRIPT.match(lines[k]):
                    break
                if not (_signature_line(lines[k], names) or _CLOSING.match(lines[k].strip()) or _RULE.match(lines[k])):
                    break
                labels[k] = "signature"
                k += 1
            j = k
        else:
            j += 1


def _signature_line(line: str, names: set[str]) -> bool:
    text = line.strip()
    if _POSTSCRIPT.match(text):
        return False
    words = set(re.findall(r"[^\W\d_]+", text.casefold()))
    short = len(text) <= 70 and not re.search(r"[.!?]\s*$", text)
    return _names_sender(text, names) or short and bool(_CONTACT.search(text)) or short and bool(words & names) and len(words) <= 8


def _tail(lines: list[str], blank: list[bool], labels: list[str | None], at: int, names: set[str]) -> bool:
    """Whether nothing but signature lines, notes and older text follows ``at`` (quotes may)."""
    for k in range(at + 1, len(lines)):
        if blank[k]:
            continue
        if labels[k] in ("quote", "attribution", "forwarded"):
            return True
        if labels[k] or _RULE.match(lines[k]) or _CLOSING.match(lines[k].strip()) or _signature_line(lines[k], names):
            continue
        return bool(_POSTSCRIPT.match(lines[k]))
    return True


def new_lines(df: DataFrame, key: str, text: str = "chunk_text", only_new: bool = True) -> DataFrame:
    """Columns: key, line_no, line, label.  One narrow stage in Arrow batches, no shuffle."""
    rows = df.filter(F.col(text).isNotNull()).select(key, F.col(text).alias("_text"))
    key_type = df.schema[key].dataType.simpleString()

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, number, line, kind = [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                lines = t.split("\n")
                for no, what in label_lines(t):
                    if what == "new" or not only_new:
                        take.append(i)
                        number.append(no)
                        line.append(lines[no])
                        kind.append(what)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(take, pa.int64())), pa.array(number, pa.int32()), pa.array(line, pa.string()), pa.array(kind, pa.string())], [key, "line_no", "line", "label"]
            )

    return rows.mapInArrow(label, f"{key} {key_type}, line_no int, line string, label string")
