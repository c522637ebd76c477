"""Rewriters whose blocks reach back or ahead, written as plain loops over one text: what tests hold the expressions against."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import pairwise

CAPITAL, SMALL = "A-ZÁÉÍÓÚÀÂÊÔÃÕÇ", "a-záéíóúàâêôãõç"
INVISIBLE = dict.fromkeys((0x200B, 0x200C, 0x200D, 0xFEFF))
_VALUES = dict(zip("IVXLC", (1, 5, 10, 50, 100), strict=True))


def from_roman(s: str) -> int:
    values = [_VALUES.get(c, 0) for c in s]
    return sum(-a if a < b else a for a, b in pairwise([*values, 0]))


def to_roman(n: int) -> str:
    digits = lambda d, one, five, ten: [one * d, one + five, five + one * (d - 5), one + ten][(d >= 4) + (d >= 5) + (d >= 9)] if d else ""
    return "C" * (n // 100) + digits(n // 10 % 10, "X", "L", "C") + digits(n % 10, "I", "V", "X")


class Cursor:
    """Lines read from the front."""

    def __init__(self, text: str) -> None:
        self.lines, self.at = text.split("\n"), 0

    @property
    def more(self) -> bool:
        return self.at < len(self.lines)

    def peek(self) -> str | None:
        """The next line without blanks at its ends, or None."""
        return self.lines[self.at].strip() if self.more else None

    def take(self) -> str:
        self.at += 1
        return self.lines[self.at - 1]

    def while_(self, test: Callable[[str], bool]) -> list[str]:
        """Takes stripped lines as long as ``test`` holds."""
        out = []
        while self.more and test(self.peek()):
            out.append(self.take().strip())
        return out


def share_upper(s: str) -> float:
    """Upper-case letters among letters; 0 without letters."""
    letters = [c for c in s if c.isalpha()]
    return sum(c.isupper() for c in letters) / len(letters) if letters else 0.0


def loud(s: str) -> bool:
    """No letter of the line would change in upper case."""
    return s.upper() == s


_ROMAN_TITLE = re.compile(r"[IVXLC]+ *[-–—.] *(.{2,})", re.DOTALL)
_NUMBER_TITLE = re.compile(r"\d+\. *(.{2,})", re.DOTALL)


def bare(s: str) -> str:
    return s.translate(INVISIBLE | {0xA0: None}).strip()


def is_roman_title(line: str) -> bool:
    s = line.strip()
    if s.startswith("**") and s.endswith("**"):
        s = s[2:-2].strip()
    s = bare(s)
    m = _ROMAN_TITLE.fullmatch(s)
    return len(s) >= 4 and bool(m) and share_upper(m[1]) >= 0.6


def is_number_title(line: str) -> bool:
    s = bare(line.strip())
    m = _NUMBER_TITLE.fullmatch(s)
    return len(s) >= 5 and bool(m) and m[1][0].isupper() and share_upper(m[1]) >= 0.6


_WIDE = rf"[{CAPITAL}][{CAPITAL}{SMALL}\s,§°º().\-:/\d]"
_WIDE_LINE, _WIDE_NUMBERED = re.compile(_WIDE + "*$"), re.compile(rf"\d+\.\s+{_WIDE}+$")
_NAMED = re.compile(rf"(D[AO]S?|PRELIMINAR|FUNDAMENTAÇÃO|RELATÓRIO|DISPOSITIVO|EMENTA|VOTO)\s+[{CAPITAL}]")
_OPEN_END = re.compile(r"\b(?:DE|DA|DO|DAS|DOS|NA|NO|NAS|NOS|EM|COM|E|OU|PARA|POR|AO|AOS|À|ÀS|ANTE|PERANTE|SOBRE|SOB|ENTRE|ESTE|ESTA|DESTE|DESTA)\s*$")


def rebuild_headings(text: str) -> str:
    """Joins headings that page lines broke: a lone number with the title below, and titles with what continues them."""
    text = unicodedata.normalize("NFC", text).replace("\xa0", " ").replace("​", "")
    cur = Cursor(text)
    if len(cur.lines) < 2:
        return text

    def continued(head: str, longest: int, free: int) -> str:
        """Appends wide lines below ``longest``; without a connector before them only those below ``free``."""
        while (s := cur.peek()) and _WIDE_LINE.match(s) and len(s) < longest and (len(s) < free or _OPEN_END.search(head)):
            head = f"{head} {cur.take().strip()}"
        return head

    out = []
    while cur.more:
        line = cur.take()
        s = line.strip()
        if re.match(r"\d+\.$", s):
            start = cur.at

            def fragment(x: str, number: str = s) -> bool:
                if not x or len(x) > 60 or x[0].islower() or (re.match(r"\d+\.", x) and x != number):
                    return False
                return x.isupper() or (len(x) < 40 and sum(map(str.isupper, x)) > sum(map(str.islower, x)))

            joined = " ".join([s, *cur.while_(fragment)])
            if cur.at > start and len(joined) > 10:
                out.append(joined)
            else:
                cur.at = start
                out.append(line)
        elif len(s) < 3:
            out.append(line)
        elif _WIDE_NUMBERED.match(s):
            out.append(continued(s, 80, 40))
        elif _NAMED.match(s) and s.isupper() and len(s) < 100:
            out.append(continued(s, 60, 30))
        elif s.isupper() and len(s) < 100 and _OPEN_END.search(s):
            out.append(continued(s, 80, 80))
        else:
            out.append(line)
    return "\n".join(out)


_NUMBERED_CAPITAL = re.compile(rf"\d+\.\s+[{CAPITAL}]")
_EMENTA = re.compile(r"(?:#{1,6}\s+)?EMENTA\s*(?:[:.]?\s*$|[-–—:.])", re.IGNORECASE)
_COURT = re.compile(r"\(\s*(?:STF|STJ|TST|TJ[A-Z]{2}|TRF|TRT|TSE)\b.*?\)|\(\s*(?:RE|REsp|HC|MS|ADI|ADPF|AgRg|AI|RMS)\s+[\d./-]+", re.IGNORECASE)
_CASE = re.compile(r"No\s+(?:HC|RHC|AgRg\s+no\s+(?:RHC|AREsp|REsp)|REsp|ARE|AREsp|ADI|ADPF|RE|EREsp|PEDILEF|AgInt\s+no\s+(?:AREsp|REsp)|RMS|CC)\s+[\d./-]+", re.IGNORECASE)


def _section_start(s: str) -> bool:
    return s.startswith("#") or (bool(_NUMBERED_CAPITAL.match(s)) and loud(s))


def _blanks_allowed(cur: Cursor, most: int, stop: Callable[[str], bool]) -> list[str]:
    """Stripped lines up to ``most`` blank ones in a row or ``stop``; blanks are passed over."""
    out, blanks = [], 0
    while cur.more and not stop(s := cur.peek()):
        blanks = 0 if s else blanks + 1
        if blanks == most:
            break
        cur.take()
        if s:
            out.append(s)
    return out


def detect_quotes(text: str, citations: bool = True) -> str:
    """Block quotes: head notes, long quotations that name a court, and (``citations``) paragraphs on a case."""
    cur, out = Cursor(text), []

    def quote(lines: list[str]) -> None:
        out.extend(f"> {x}" for x in lines)
        out.append("")

    while cur.more:
        line = cur.take()
        s = line.strip()
        if _EMENTA.match(s):
            quote([s, *_blanks_allowed(cur, 2, _section_start)])
        elif s.startswith(("“", '"')) and len(s) > 50:
            lines, closed = [s], "”" in s or (s[0] == '"' and s.count('"') >= 2)
            while not closed and cur.more and cur.peek():
                lines.append(cur.take().strip())
                closed = "”" in lines[-1] or lines[-1].endswith('"')
            named = bool(_COURT.search(" ".join(lines)))
            if not named and cur.more and _COURT.search(cur.peek()):
                named = True
                lines.append(cur.take().strip())
            if named and closed:
                quote(lines)
            else:
                out += lines
        elif citations and _CASE.match(s):
            quote([s, *cur.while_(lambda x: bool(x) and not _section_start(x) and not _CASE.match(x) and not is_number_title(x) and not is_roman_title(x))])
        else:
            out.append(line)
    return "\n".join(out)


_NOTE = re.compile(
    r"(?:#{1,6}\s+)?(?:Observa[çc][oõ]es?\s+finais?\s+de\s+uso|Nota\s+de\s+adequa[çc][aã]o|Instru[çc][oõ]es?\s+para\s+protocolo|Nota\s+interna|Observa[çc][oõ]es?\s+ao\s+advogado|Instru[çc][oõ]es?\s+ao\s+cliente)", re.IGNORECASE
)
NOTE_BANNER = "> **Nota interna** — nao integra a peca processual."


def wrap_notes(text: str) -> str:
    """Notes that are no part of the document become quotes under a banner, up to a heading or three blank lines."""
    cur, out = Cursor(text), []
    while cur.more:
        line = cur.take()
        if _NOTE.match(s := line.strip()):
            body = _blanks_allowed(cur, 3, lambda x: x.startswith("#") and not _NOTE.match(x))
            out += ["", NOTE_BANNER, ">", *(f"> {x}" for x in (s, *body)), ""]
        else:
            out.append(line)
    return "\n".join(out)


_TITLE = r"[{u}][{u}\s,§°º().\-:/\d]{{2,}}$".replace("{u}", CAPITAL).replace("{{", "{").replace("}}", "}")
_RAW_NUMBERED, _ANY_NUMBERED = re.compile(r"\d+\.\s+" + _TITLE), re.compile(rf"\d+\.\s+[{CAPITAL}].{{2,}}$")
_RAW_ROMAN, _RAW_UPPER = re.compile(r"[IVXLC]+\s*[-–—.]\s+" + _TITLE), re.compile(_TITLE)
_EMBEDDED = re.compile(rf"\S\s+(\d+\.\s+[{CAPITAL}][{CAPITAL}\s]{{3,}})")
_CONNECTOR = re.compile(r"\b(?:DE|DA|DO|DOS|DAS|E|OU|A|AO|AOS|À|ÀS|NA|NO|NAS|NOS|EM|COM|PARA|POR|ANTE|PERANTE|SOB|SOBRE|ENTRE)\s*$")
UNTITLED = "[SEÇÃO SEM TÍTULO DETECTADO]"


def _gaps(found: list[tuple[int, int]]) -> tuple[list[int], dict[int, int]]:
    """Numbers missing between the first and the last found, and the last line of each number that is there."""
    where = dict(found)
    return sorted(set(range(found[0][0], found[-1][0] + 1)) - set(where)) if len(found) > 1 else [], where


def _inserted(lines: list[str], at: list[tuple[int, str]]) -> list[str]:
    for place, heading in sorted(at, reverse=True):
        lines[place:place] = ["", heading, ""]
    return lines


def fill_heading_gaps(text: str) -> str:
    """Promotes bare numbered titles to headings and puts headings where a number is missing between two."""
    text = unicodedata.normalize("NFC", text).replace("\xa0", " ").translate(INVISIBLE)
    lines: list[str] = []
    for line in text.split("\n"):
        m = _EMBEDDED.search(line) if len(line) > 80 else None
        lines += [line[: m.start(1)].rstrip(), line[m.start(1) :]] if m else [line]

    def numbered(s: str) -> bool:
        return bool(_RAW_NUMBERED.match(s) or (_ANY_NUMBERED.match(s) and share_upper(s) > 0.5))

    def promoted(cur: Cursor) -> Iterator[str]:
        while cur.more:
            line = cur.take()
            s = line.strip()
            inner = s.lstrip(">").strip()
            if s.startswith("#"):
                yield line
            elif s.startswith(">") and numbered(inner):
                yield f"## {inner}"
            elif numbered(s):
                joins = _CONNECTOR.search(s) and cur.more and _RAW_UPPER.match(cur.peek())
                yield f"## {s} {cur.take().strip()}" if joins else f"## {s}"
            else:
                yield line

    def roman(line: str) -> str:
        s = line.strip()
        inner = s.lstrip(">").strip()
        return f"## {inner}" if not s.startswith("#") and _RAW_ROMAN.match(inner) and loud(inner) else line

    lines = [roman(x) for x in promoted(Cursor("\n".join(lines)))]
    missing, where = _gaps([(int(m[1]), i) for i, x in enumerate(lines) if (m := re.match(r"##\s+(\d+)\.", x))])
    at = []
    for n in missing:
        end = where[min(k for k in where if k > n)]
        sub = re.compile(rf"(?:###?\s+)?(?:\*\*{n - 1}\.\d+\.?\*\*|{n - 1}\.\d+\.)")
        place = max((i + 1 for i in range(where.get(n - 1, 0), end) if sub.match(lines[i].strip())), default=end)
        while place < end and lines[place].strip():
            place += 1
        title = UNTITLED
        for i in range(max(0, place - 10), place):
            s = lines[i].strip()
            if s and s[0] != "#" and len(s) < 100 and sum(map(str.isalpha, s)) > 3 and share_upper(s) > 0.6:
                title, lines[i] = s, ""
                break
        at.append((place, f"## {n}. {title}"))
    lines = _inserted(lines, at)
    missing, where = _gaps([(v, i) for i, x in enumerate(lines) if (m := re.match(r"##\s+([IVXLC]+)\s*[-–—.]\s+.+$", x)) and (v := from_roman(m[1]))])
    at = []
    for n in missing:
        place = where[min(k for k in where if k > n)]
        while place and not lines[place - 1].strip():
            place -= 1
        at.append((place, f"## {to_roman(n)} – {UNTITLED}"))
    return "\n".join(_inserted(lines, at))


_CONTENTS_HEAD = re.compile(r"#{1,3}\s+(?:Sumário|Índice|SUMÁRIO|ÍNDICE)\s*$")
FIELDS = "titulo data status convertido_em proad orgao_emissor tipo_peca paciente autor reu impetrante autoridade_coatora pedido_liminar processo_origem comarca acoes_cumuladas".split()
_FIELD = re.compile(rf"(?:{'|'.join(FIELDS)})\s*:", re.IGNORECASE)


def strip_front_matter(text: str, run: int = 5) -> str:
    """Drops what an earlier conversion left: front matter, field lines, contents, and ``run`` or more headings in a row."""
    cur, out = Cursor(text), []
    if cur.peek() == "---":
        cur.take()
        cur.while_(lambda x: x != "---")
        if cur.more:
            cur.take()
    while cur.more:
        s = cur.peek()
        if _CONTENTS_HEAD.match(s):
            cur.take()
            cur.while_(lambda x: x.startswith("- ["))
            if cur.more and not cur.peek():
                cur.take()
            continue
        if _FIELD.match(s) or re.match(r"\w+:\s+[\"'].*[\"']\s*\w*:\s*[\"']", s):
            cur.take()
            continue
        if s.startswith("- [") and "](#" not in s:
            start = cur.at
            if len(cur.while_(lambda x: x.startswith("- ["))) >= 3:
                cur.while_(lambda x: not x)
                continue
            cur.at = start
        out.append(cur.take())
    return "\n".join(_without_heading_runs(out, run))


def _without_heading_runs(lines: list[str], run: int) -> list[str]:
    """Of ``run`` or more headings with only blanks between them the last stays, or none at the end of the text."""
    out: list[str] = []
    heads: list[int] = []
    for line in [*lines, None]:
        s = "" if line is None else line.strip()
        if line is not None and re.match(r"#{1,6}\s+", s):
            heads.append(len(out))
        elif line is None or s:
            if len(heads) >= run:
                out = out[: heads[0]] + ([] if line is None else out[heads[-1] :])
            heads = []
        if line is not None:
            out.append(line)
    return out
