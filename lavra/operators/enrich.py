"""Classification: language, legal area, tags, kinds of blocks.  First-declared names win ties throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lavra.functions import runs, rx, scalars
from lavra.functions.lines import flat_map_lines, let, map_lines, one, split
from lavra.operators import phrases
from lavra.operators.paragraphs import SMALL

# The results are defined by exactly these lists.
LANGUAGES = {
    "por": [
        "de", "do", "da", "dos", "das", "que", "para", "com", "por", "não", "uma", "seu", "sua", "nos", "pelo", "pela", "este", "esta", "artigo", "lei", "processo", "tribunal", "juiz",
        "sentença", "recurso",
    ],
    "eng": [
        "the", "and", "for", "that", "with", "this", "from", "not", "but", "are", "was", "were", "have", "has", "been", "will", "would", "court", "law", "judge", "case", "shall", "section",
    ],
    "spa": [
        "del", "los", "las", "que", "para", "con", "por", "una", "sus", "este", "esta", "como", "más", "pero", "han", "ley", "tribunal", "juez", "sentencia", "recurso", "artículo",
    ],
    "fra": [
        "les", "des", "que", "pour", "avec", "par", "dans", "une", "sur", "est", "sont", "pas", "cette", "mais", "loi", "tribunal", "juge", "article", "décision",
    ],
    "deu": [
        "der", "die", "das", "und", "den", "von", "mit", "für", "auf", "ein", "ist", "nicht", "des", "dem", "auch", "gericht", "gesetz", "richter", "urteil", "artikel",
    ],
    "ita": [
        "del", "dei", "che", "per", "con", "una", "gli", "non", "suo", "sua", "nel", "dalla", "questo", "questa", "legge", "tribunale", "giudice", "sentenza", "articolo",
    ],
}
STOP_WORDS = [
    "de", "do", "da", "dos", "das", "em", "no", "na", "nos", "nas", "por", "para", "com", "que", "se", "um", "uma", "ao", "aos", "ou", "não", "mais", "sua", "seu", "pela", "pelo", "como",
    "este", "esta", "esse", "essa", "são", "foi", "será", "pode", "deve", "tem", "ter", "ser", "está", "há", "já", "entre", "sobre", "quando", "também", "muito", "bem", "até", "sem", "isso",
    "isto", "todo", "toda", "ainda", "então", "mas", "artigo", "art", "parágrafo", "inciso", "alínea", "caput", "texto", "forma", "caso", "modo", "parte", "acordo", "lei", "direito",
    "tribunal", "juiz", "sentença",
]
AREAS = {
    "Direito Penal": [
        "crime", "delito", "pena", "reclusão", "detenção", "tipicidade", "antijuridicidade", "culpabilidade", "dolo", "culpa", "imputabilidade", "código penal", "CP", "homicídio", "furto",
        "roubo", "estelionato", "lesão corporal", "ação penal",
    ],
    "Direito Constitucional": [
        "constituição", "constitucional", "direito fundamental", "garantia", "mandado de segurança", "habeas corpus", "ação direta", "ADI", "ADPF", "controle de constitucionalidade",
        "cláusula pétrea", "emenda constitucional",
    ],
    "Direito Processual Civil": [
        "CPC", "código de processo civil", "citação", "intimação", "contestação", "réplica", "sentença", "acórdão", "recurso especial", "recurso extraordinário", "recurso de apelação",
        "tutela antecipada", "tutela provisória", "tutela de urgência", "execução", "cumprimento de sentença",
    ],
    "Direito do Trabalho": [
        "CLT", "trabalhista", "empregado", "empregador", "vínculo empregatício", "rescisão", "FGTS", "férias", "jornada de trabalho", "salário", "aviso prévio",
    ],
    "Direito Tributário": [
        "tributo", "imposto", "taxa", "contribuição", "CTN", "fato gerador", "base de cálculo", "alíquota", "ICMS", "ISS", "IPTU", "IPVA", "IR", "PIS", "COFINS",
    ],
    "Direito Administrativo": [
        "administração pública", "ato administrativo", "licitação", "contrato administrativo", "servidor público", "poder de polícia", "improbidade", "Lei 8.666", "Lei 8666", "concessão",
        "permissão",
    ],
    "Direito Empresarial": [
        "empresa", "sociedade limitada", "sociedade anônima", "falência", "recuperação judicial", "CNPJ", "quotas", "quota", "ações", "açõe", "título de crédito", "nota promissória",
    ],
    "Direito Ambiental": [
        "meio ambiente", "ambiental", "licenciamento", "poluição", "fauna", "flora", "IBAMA", "reserva legal", "área de proteção",
    ],
    "Direito Processual Penal": [
        "CPP", "código de processo penal", "inquérito", "flagrante", "prisão preventiva", "denúncia", "queixa-crime", "júri", "tribunal do júri",
    ],
    "Direito Civil": [
        "código civil", "pessoa natural", "pessoa jurídica", "capacidade civil", "obrigação", "contrato", "posse", "propriedade", "responsabilidade civil", "família", "sucessão", "herança",
        "casamento", "divórcio", "LINDB", "prescrição", "decadência", "negócio jurídico",
    ],
}
SUBAREAS = {
    "Direito Penal": {
        "Crimes contra a pessoa": [
            "homicídio", "lesão corporal", "ameaça", "constrangimento", "sequestro", "cárcere",
        ],
        "Crimes contra o patrimônio": [
            "furto", "roubo", "extorsão", "estelionato", "receptação", "dano", "apropriação",
        ],
        "Teoria do delito": [
            "tipicidade", "antijuridicidade", "culpabilidade", "imputabilidade", "dolo", "culpa", "nexo causal",
        ],
    },
    "Direito Constitucional": {
        "Direitos fundamentais": [
            "direito fundamental", "liberdade", "igualdade", "dignidade", "direitos sociais", "direitos sociai", "direito sociais", "direito sociai",
        ],
        "Controle de constitucionalidade": [
            "ADI", "ADPF", "controle difuso", "controle concentrado", "ação direta", "inconstitucionalidade",
        ],
    },
    "Direito Processual Civil": {
        "Processo de conhecimento": [
            "petição inicial", "contestação", "réplica", "instrução", "sentença", "audiência",
        ],
        "Recursos": [
            "apelação", "agravo", "embargo", "recurso especial", "recurso extraordinário",
        ],
    },
    "Direito Civil": {
        "LINDB / Parte Geral": [
            "LINDB", "Lei de Introdução", "pessoa natural", "capacidade", "personalidade", "domicílio",
        ],
        "Obrigações": [
            "obrigação", "devedor", "credor", "adimplemento", "inadimplemento", "mora", "pagamento",
        ],
        "Contratos": [
            "contrato", "compra e venda", "locação", "doação", "mandato", "fiança", "empreitada",
        ],
        "Responsabilidade Civil": [
            "responsabilidade civil", "dano moral", "dano material", "indenização", "culpa", "nexo causal",
        ],
        "Família e Sucessões": [
            "família", "casamento", "divórcio", "união estável", "guarda", "alimentos", "herança", "inventário", "testamento", "sucessão",
        ],
    },
}
LATIN = [
    "vacatio legis", "norma agendi", "jus cogens", "habeas corpus", "habeas data", "ad hoc", "in dubio pro reo", "pacta sunt servanda", "erga omnes", "inter partes", "ex tunc", "ex nunc", "ab initio",
    "a priori", "a posteriori", "de facto", "de jure", "in limine", "fumus boni juris", "periculum in mora", "res judicata", "modus operandi", "stare decisis", "lex specialis", "lex posterior",
    "ultra petita", "extra petita", "citra petita", "animus necandi", "animus domini", "lato sensu", "stricto sensu", "ad quem", "a quo", "prima facie", "mutatis mutandis", "data venia",
    "sine qua non", "numerus clausus", "nulla poena sine lege", "nullum crimen sine lege",
]
CONCEPTS = [
    "pessoa jurídica", "pessoa natural", "capacidade civil", "prescrição", "decadência", "responsabilidade civil", "ato jurídico", "negócio jurídico", "fato jurídico", "obrigação", "contrato", "posse", "propriedade",
    "boa-fé", "função social", "dignidade da pessoa humana", "devido processo legal", "contraditório", "ampla defesa", "segurança jurídica", "coisa julgada", "ato administrativo", "poder de polícia",
    "serviço público", "licitação", "dano moral", "dano material", "nexo causal", "tutela antecipada", "tutela provisória",
]
AUTHORS = [
    "PONTES DE MIRANDA", "MIGUEL REALE", "CLÓVIS BEVILÁQUA", "CAIO MÁRIO", "ORLANDO GOMES", "SILVIO RODRIGUES", "MARIA HELENA DINIZ", "FLÁVIO TARTUCE", "PABLO STOLZE", "RODOLFO PAMPLONA", "NELSON NERY",
    "HUMBERTO THEODORO", "CÂNDIDO RANGEL DINAMARCO", "FREDIE DIDIER", "DANIEL AMORIM", "GUILHERME DE SOUZA NUCCI", "ROGÉRIO GRECO", "FERNANDO CAPEZ", "LUIZ FLÁVIO GOMES", "CELSO ANTÔNIO BANDEIRA DE MELLO",
]
COURTS = r"\b(STF|STJ|TST|TSE|STM|TRF\d?|TJ[A-Z]{2}|TJSP|TJRJ|TJMG|TJRS|TJPR|TJSC|TJBA|TJPE|TJCE|TJGO|TJDF)\b"
#: Kinds of blocks in the order they are tried: (callout, pattern, whether it must stand at the start, greatest length).
BLOCKS = [
    ("> [!QUOTE] Legislação", r"\s*(?:\*\*)?(?:Art\.?\s+\d+|§\s*\d+|Inciso\s+[IVX]+|Parágrafo\b)", True, None),
    ("> [!QUOTE] Súmula", r"\s*(?:\*\*)?S[úu]mula\s+\d+", True, None),
    ("> [!QUOTE] Enunciado", r"\s*(?:\*\*)?Enunciado\s+\d+", True, None),
    ("> [!QUOTE] Jurisprudência", r"\s*(?:\*\*)?(?:STF|STJ|TST|TSE|TRF\d?|TJ[A-Z]{2})\s*\.?\s*(?:\d+ª\s*(?:Turma|Seção)|REsp|HC|RE|MS|AgRg)", True, None),
    ("> [!TIP] Questão de concurso", r"\((?:CESPE|CEBRASPE|FGV|FCC|VUNESP|FUNDATEC|IBFC|IADES|MPE|MPT|TRF|TRT|TJ|FUMARC|CONSULPLAN|FUNCAB|UFRGS|FUNDEP)[\s/\-—]", False, None),
    ("> [!WARNING] Atenção", r"\s*(?:\*\*)?(?:Aten[çc][ãa]o|Cuidado|Pegadinha|CUIDADO|ATEN[ÇC][ÃA]O)\s*[:!]", True, None),
    ("> [!IMPORTANT]", r"\s*(?:\*\*)?(?:Importante|N[ãa]o\s+confundir|Distin[çc][ãa]o|IMPORTANTE|DISTIN[ÇC][ÃA]O)\s*[:!]", True, None),
    ("> [!NOTE]", r"\s*(?:\*\*)?(?:Obs\.?|OBS\.?|Observa[çc][ãa]o)\s*[:!]", True, None),
    ("> [!INFO] Definição", r"\b(?:consiste\s+em|é\s+definid[oa]\s+como|trata[-\s]se\s+de|entende[-\s]se\s+por|conceitua[-\s]se|define[-\s]se\s+como|pode\s+ser\s+definid[oa]\s+como)\b", False, 400),
]


def classify_block(paragraph: Column) -> Column:
    """The callout of a paragraph, or null for prose: the first kind that matches."""
    s = rx.strip(paragraph)
    out = F.lit(None).cast("string")
    for kind, p, head, most in reversed(BLOCKS):
        test = rx.has(s, ("^" if head else "") + p, "i")
        out = F.when(test if most is None else test & (F.char_length(s) < most), kind).otherwise(out)
    return F.when(s != "", out)


LANGUAGE_WORD = "[a-záàâãéèêíïóôõúüçñ]+"


def detect_language(text: Column, min_words: int = 20, default: str = "por") -> Column:
    """The language with the most frequent words; ``default`` for null, short, wordless or ambiguous texts.

    One search keeps the words that some language has; only these are counted by language.
    """
    every = sorted({w for words in LANGUAGES.values() for w in words})

    def judge(words: Column) -> Column:
        known = F.filter(words, lambda w: w.isin(every))
        spoken = lambda own: lambda w: w.isin(own)
        counts = lambda found: F.array(*(F.size(F.filter(found, spoken(own))) for own in LANGUAGES.values()))
        unsure = lambda c, top: (F.size(words) < min_words) | (F.aggregate(c, F.lit(0), lambda a, n: a + n) < 5) | (F.get(top, 1) > 0.8 * F.get(top, 0))
        best = lambda c: F.when(let(F.sort_array(c, asc=False), lambda top: unsure(c, top)), default).otherwise(scalars.argmax(c, list(LANGUAGES)))
        return let(let(known, counts), best)

    return F.coalesce(F.when(F.char_length(rx.strip(text)) >= 30, let(rx.all_of(F.lower(text), LANGUAGE_WORD), judge)), F.lit(default))


def sampled_pages(pages: DataFrame, sample: int = 10) -> DataFrame:
    """``doc_id, page_idx, text`` of at most ``sample`` pages of a document, evenly spread."""
    n = F.count("*").over(Window.partitionBy("doc_id"))
    step = F.col("n") / F.lit(float(sample))
    chosen = F.transform(F.sequence(F.lit(0), F.lit(sample - 1)), lambda i: F.floor(i * step).cast("int"))
    return pages.withColumn("n", n).filter((F.col("n") <= sample) | F.array_contains(chosen, F.col("page_idx"))).drop("n")


def vote_language(pages: DataFrame, sample: int = 10, default: str = "por") -> DataFrame:
    """``doc_id, language``: the most frequent language of sampled pages with text; the first seen wins ties."""
    seen = sampled_pages(pages, sample).withColumn("language", F.when(F.char_length(rx.strip(F.col("text"))) > 30, detect_language(F.col("text"))))
    votes = seen.groupBy("doc_id", "language").agg(F.count("language").alias("n"), F.min("page_idx").alias("at"))
    return votes.groupBy("doc_id").agg(F.coalesce(F.max_by("language", F.when(F.col("n") > 0, F.struct("n", -F.col("at")))), F.lit(default)).alias("language"))


def legal_area(text: Column, sample: int = 8000) -> Column:
    """``struct<area, subarea>`` by counts of key phrases in the first ``sample`` characters, all found in one pass."""
    every = [p for kinds in (AREAS, *SUBAREAS.values()) for own in kinds.values() for p in own]

    def best(found: Column, kinds: dict[str, list[str]], otherwise: Column) -> Column:
        return let(phrases.counts(found, list(kinds.values())), lambda c: F.when(F.array_max(c) > 0, scalars.argmax(c, list(kinds))).otherwise(otherwise))

    def judge(found: Column) -> Column:
        def sub(area: Column) -> Column:
            out = F.lit("Geral")
            for name, kinds in SUBAREAS.items():
                out = F.when(area == name, best(found, kinds, F.lit("Geral"))).otherwise(out)
            return out

        area = best(found, AREAS, F.lit(None).cast("string"))
        return let(area, lambda a: F.struct(F.coalesce(a, F.lit("Direito Civil")).alias("area"), F.when(a.isNull(), "Geral").otherwise(sub(a)).alias("subarea")))

    return let(phrases.hits(F.substring(F.coalesce(text, F.lit("")), 1, sample), every), judge)


def tags(docs: DataFrame, most: int = 5, least_letters: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, rank, tag, n``: each document's most frequent words that are no stop words; the first seen wins ties.

    A row's words are counted within the row, and only its ``most`` tags are shuffled to see whether its id is its own.  Rows
    that share an id are one document; the words of these alone are shuffled.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    per_row = own.select("doc_id", counted_words(_tag_words(F.col("text"), least_letters), most).alias("found"))
    per_id = per_row.groupBy("doc_id").agg(F.count("*").alias("rows"), F.first("found").alias("found"))
    alone = per_id.filter("rows = 1").select("doc_id", F.posexplode("found").alias("rank", "t"))
    alone = alone.select("doc_id", (F.col("rank") + 1).alias("rank"), F.col("t.w").alias("tag"), (-F.col("t.less")).cast("long").alias("n"))
    shared = per_id.filter("rows > 1").select(F.col("doc_id").alias("_id"))
    words = own.join(shared, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("doc_id", F.posexplode(_tag_words(F.col("text"), least_letters)).alias("at", "tag"))
    counts = words.groupBy("doc_id", "tag").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("n").desc(), "at"))
    return alone.union(counts.withColumn("rank", rank).filter(F.col("rank") <= most).select("doc_id", "rank", "tag", "n"))


def _tag_words(text: Column, least_letters: int) -> Column:
    return F.filter(rx.all_of(F.lower(text), f"[a-záéíóúàâêôãõç]{{{least_letters},}}"), lambda w: ~w.isin(STOP_WORDS))


def counted_words(words: Column, most: int) -> Column:
    """The most frequent of an array's words: ``less`` (their number below zero), ``at`` (the first place), ``w``; the first seen wins ties.

    Equal words meet by sorting, so no word is compared with all.
    """

    def count(found: Column) -> Column:
        n = F.size(found)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(found, i)["w"] != F.get(found, i - 1)["w"]))
        runs_ = lambda at: F.transform(at, lambda i, k: F.struct((i - F.coalesce(F.get(at, k + 1), n)).alias("less"), F.get(found, i)["at"].alias("at"), F.get(found, i)["w"].alias("w")))
        return F.slice(F.array_sort(let(starts, runs_)), 1, most)

    placed = F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("at"))))
    return let(placed, lambda found: F.when(F.size(found) > 0, count(found)).otherwise(F.array().cast("array<struct<less:int,at:int,w:string>>")))


def top_words(words: Column, most: int) -> Column:
    """The most frequent of an array's words; the first seen wins ties."""
    return F.transform(counted_words(words, most), lambda x: x["w"])


def tag_list(text: Column, most: int = 5, least_letters: int = 4) -> Column:
    """The same as an array within the row, for the pipeline; null for null."""
    return F.when(text.isNotNull(), top_words(_tag_words(text, least_letters), most))


_ALERT = r"^(?:ATENÇÃO|Atenção|Cuidado|CUIDADO|Importante|IMPORTANTE|Não\s+confundir|Distinção|DISTINÇÃO|Observação|OBSERVAÇÃO)\s*[:\-–—]?\s*"
_DEFINES = r"^(.+?)\s+(?:é|são|consiste|define-se\s+como|entende-se\s+por|conceito\s+de)\s+"


def insert_callouts(text: Column) -> Column:
    """The older, line-wise callouts: alerts, and definitions of 31 to 299 characters."""

    def body(line: Column, i: Column, all_: Column) -> Column:
        s = rx.strip(line)
        n = F.char_length(s)
        return (
            F.when(s.startswith("#") | s.startswith(">"), one(line))
            .when(rx.has(s, _ALERT, "i"), F.array(F.lit("> [!IMPORTANT]"), F.concat(F.lit("> "), s)))
            .when(rx.has(s, _DEFINES, "i") & (n > 30) & (n < 300), F.array(F.lit("> [!NOTE] Definição"), F.concat(F.lit("> "), s)))
            .otherwise(one(line))
        )

    return flat_map_lines(text, body)


def _by_letter(names: list[str]) -> str:
    """An alternation that looks at each first letter once; names with the same one keep their order."""
    groups: dict[str, list[str]] = {}
    for name in names:
        groups.setdefault(name[0].lower(), []).append(name[1:])
    return "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in groups.items())


def semantic_format(text: Column) -> Column:
    """Italics for Latin phrases, bold for the first mention of a concept, for courts and for named authors; headings stay.

    One search finds all kinds and headings, so a text is read once: no phrase of one kind holds, or reaches into, one of another.
    """
    kinds = "|".join(f"({_by_letter(names)})" for names in (LATIN, CONCEPTS, AUTHORS))
    # no word begins behind a small letter: a cheap test before the dear ones
    found = rf"((?m:^)\s*#[^\n]*)|(?<![a-z0-9])(?=\p{{L}})\b(?:(?<!\*)(?i:{kinds})\b(?!\*)|{COURTS.removeprefix(chr(92) + 'b')})"
    gap = "\ufdd1"
    parts = F.split(rx.sub(text, found, f"{runs.CUT}{gap.join(f'${i}' for i in range(1, 6))}{runs.CUT}"), runs.CUT, -1)

    def put(kinds: Column, own: Column, i: Column) -> Column:
        heading, latin, concept, author, court = (F.get(kinds, k) for k in range(5))
        bold = lambda x: F.concat(F.lit("**"), x, F.lit("**"))
        return (
            F.when(latin != "", F.concat(F.lit("*"), latin, F.lit("*"))).when(concept != "", F.when(F.array_position(own, F.lower(concept)) <= i, concept).otherwise(bold(concept)))
            .when(author != "", bold(F.translate(F.upper(author), "İ", "I"))).when(court != "", bold(court)).otherwise(heading)
        )

    def whole(parts: Column) -> Column:
        split_ = F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.split(p, gap, -1)))
        mentions = lambda s: F.transform(s, lambda k: F.lower(F.get(k, 2)))
        return let(split_, lambda s: let(mentions(s), lambda own: F.concat_ws("", F.transform(parts, lambda p, i: F.when(i % 2 == 1, put(F.get(s, i), own, i)).otherwise(p)))))

    return let(parts, lambda ps: F.when(F.size(ps) > 1, whole(ps)).otherwise(text))


def smart_callouts(text: Column) -> Column:
    """Paragraphs of a known kind become callouts."""
    code = lambda s, i, all_: F.when((s == "") | rx.has(s, r"^(?:[>#|]|- |\* )"), "-").otherwise("p")
    called = lambda kind, lines: F.when(kind.isNull(), lines).otherwise(F.concat(F.array(kind), F.transform(lines, lambda x: F.concat(F.lit("> "), x))))
    body = lambda r: let(F.transform(r, lambda x: runs.of(x, 1)), lambda lines: let(classify_block(F.array_join(lines, " ")), lambda kind: called(kind, lines)))
    return runs.plain(runs.rewrite(runs.coded(text, code), 1, runs.line("p") + "++", body), 1)


def section_summaries(text: Column) -> Column:
    """Behind each second-level section, if there are two or more, its first sentence and three frequent words."""

    def summary(body: Column) -> Column:
        first, words = F.get(body, 0), rx.all_of(F.lower(F.array_join(F.slice(body, 1, 10), " ")), f"[{SMALL}]{{5,}}")
        dot = F.instr(first, ".")
        sentence = F.when(dot > 21, F.substring(first, F.lit(1), dot)).when(F.char_length(first) > 120, F.concat(F.substring(first, 1, 120), F.lit("..."))).otherwise(first)
        keys = F.array_join(F.slice(F.filter(top_words(words, 5), lambda w: ~w.isin(STOP_WORDS)), 1, 3), ", ")
        return F.concat(F.lit("\n*Resumo: "), sentence, let(keys, lambda k: F.when(k == "", "").otherwise(F.concat(F.lit(" Palavras-chave: "), k, F.lit(".")))), F.lit("*\n"))

    def section(part: Column) -> Column:
        lines = F.transform(split(part), rx.strip)
        body = F.filter(F.slice(lines, 2, F.size(lines)), lambda s: (s != "") & ~rx.has(s, "^[#>]"))
        return let(body, lambda b: F.when(F.size(b) > 0, F.concat(part, summary(b))).otherwise(part))

    # a newline in front and one behind: every line is whole
    parts = F.split(F.concat(F.lit("\n"), text, F.lit("\n")), rx.rx(r"(?<=\n)(?=[^\S\n]*## )"), -1)
    whole = lambda ps: F.concat_ws("", F.transform(ps, lambda p, i: F.when(i > 0, section(p)).otherwise(p)))
    return let(parts, lambda ps: F.when(F.size(ps) > 2, let(whole(ps), lambda t: F.substring(t, F.lit(2), F.char_length(t) - 2))).otherwise(text))


def normalize_footnotes(text: Column) -> Column:
    """Numbered lines become footnote definitions (the last of a number counts) and ``(n)`` references to them."""
    pattern = r"^(\d{1,3})\s*[.)\-–—]\s*(.+)"

    def parse(line: Column) -> Column:
        s = rx.strip(line)
        note = F.struct(F.regexp_extract(s, rx.rx(pattern), 1).alias("number"), rx.strip(F.regexp_extract(s, rx.rx(pattern), 2)).alias("note"))
        return F.struct(line.alias("line"), F.when((F.char_length(s) > 20) & rx.has(s, pattern), note).alias("note"))

    def put(parsed: Column) -> Column:
        found = F.transform(F.filter(parsed, lambda x: x["note"].isNotNull()), lambda x: x["note"])
        body = rx.sub(F.array_join(F.transform(F.filter(parsed, lambda x: x["note"].isNull()), lambda x: x["line"]), "\n"), r"\((\d{1,3})\)", "[^$1]")
        last = lambda own, number: F.element_at(F.filter(own, lambda x: x["number"] == number), -1)["note"]
        numbers = lambda own: F.array_sort(F.transform(F.array_distinct(F.transform(own, lambda x: x["number"])), lambda n, i: F.struct(n.cast("int").alias("value"), i.alias("at"), n.alias("number"))))
        listed = lambda own: F.array_join(F.transform(numbers(own), lambda n: F.concat(F.lit("[^"), n["number"], F.lit("]: "), last(own, n["number"]))), "\n")
        return let(found, lambda own: F.when(F.size(own) > 0, F.concat(body, F.lit("\n\n---\n\n"), listed(own))).otherwise(body))

    return let(F.transform(split(text), parse), put)
