"""Fixed values.

Everything here must equal the values of the invoice domain for results to be
right: word lists, lookup tables, limits and text patterns. They are data, kept
together and in plain text; the logic that uses them lives elsewhere.
"""

# ---------------------------------------------------------------- months
MONTH_NUMBER = {
    "JAN": 1, "FEV": 2, "MAR": 3, "ABR": 4, "MAI": 5, "JUN": 6,
    "JUL": 7, "AGO": 8, "SET": 9, "OUT": 10, "NOV": 11, "DEZ": 12,
}
LONG_MONTH_NUMBER = {
    "JANEIRO": 1, "FEVEREIRO": 2, "MARCO": 3, "ABRIL": 4, "MAIO": 5, "JUNHO": 6,
    "JULHO": 7, "AGOSTO": 8, "SETEMBRO": 9, "OUTUBRO": 10, "NOVEMBRO": 11, "DEZEMBRO": 12,
}
MONTHS_IN_WINDOW = 13
FIXED_CYCLE = [
    "11/2024", "12/2024", "01/2025", "02/2025", "03/2025", "04/2025",
    "05/2025", "06/2025", "07/2025", "08/2025", "09/2025", "10/2025",
]

# ---------------------------------------------------------------- supply types
# Minimum billed kWh; the word fragment is looked for in order.
AVAILABILITY_KWH = {"TRIF": 100.0, "BIF": 50.0, "MONO": 30.0}
AVAILABILITY_EXACT_KWH = {
    "TRIFÁSICO": 100, "TRIFASICO": 100,
    "BIFÁSICO": 50, "BIFASICO": 50,
    "MONOFÁSICO": 30, "MONOFASICO": 30,
}
SUPPLY_TYPE_LABEL = {"TRIFASIC": "TRIFÁSICO", "BIFASIC": "BIFÁSICO", "MONOFASIC": "MONOFÁSICO"}
ZERO_KWH = 1e-9

# ---------------------------------------------------------------- output columns
OUTPUT_TEXT_COLUMNS = [
    "uc", "referencia", "categoria", "nome", "endereco", "tipo_fornecimento",
    "pdf_source", "audit_kwh_source", "provider_layout", "template",
]
OUTPUT_FLAG_COLUMNS = ["needs_review"]
OUTPUT_NUMBER_COLUMNS = [
    "kwh_total_te", "demanda_hp_kw", "demanda_fhp_kw", "consumo_hp_kwh", "consumo_fhp_kwh",
    "demanda_contratada_kw", "dif_demanda", "page_first_seen", "preco_te", "preco_tusd",
    "valor_te", "valor_tusd", "preco_all_in_kwh",
]
HISTORY_MEASURES = ["demanda_hp_kw", "demanda_fhp_kw", "consumo_hp_kwh", "consumo_fhp_kwh"]
ANALYTICS_NUMBER_COLUMNS = [
    "kwh_total_te", "demanda_item", "dif_demanda", "demanda_contratada_kw", "demanda_hp_kw",
    "demanda_fhp_kw", "consumo_hp_kwh", "consumo_fhp_kwh", "total_fatura_rs",
    "itens_fatura_total_valor_rs", "itens_fatura_energia_valor_rs", "itens_fatura_energia_kwh",
    "itens_fatura_preco_medio_rs_kwh", "itens_fatura_preco_all_in_fhp_rs_kwh",
    "itens_fatura_preco_all_in_hp_rs_kwh", "itens_fatura_preco_all_in_blended_rs_kwh",
]
ITEM_MEASURES = [
    "itens_fatura_total_valor_rs", "itens_fatura_energia_valor_rs", "itens_fatura_energia_kwh",
    "itens_fatura_preco_medio_rs_kwh", "itens_fatura_preco_all_in_fhp_rs_kwh",
    "itens_fatura_preco_all_in_hp_rs_kwh", "itens_fatura_preco_all_in_blended_rs_kwh",
]
DISPLAY_COLUMN_ORDER = [
    "municipio", "referencia", "reference_date", "uc", "nome", "endereco",
    "categoria", "tipo_fornecimento", "kwh_total_te", "demanda_contratada_kw",
    "demanda_hp_kw", "demanda_fhp_kw", "consumo_hp_kwh", "consumo_fhp_kwh",
    "total_fatura_rs", "itens_fatura_total_valor_rs", "itens_fatura_energia_valor_rs",
    "itens_fatura_energia_kwh", "itens_fatura_preco_medio_rs_kwh", "dif_demanda",
    "extra_demand_kw", "estimated_energy_cost_rs", "estimated_extra_demand_cost_rs",
    "actual_total_cost_rs", "estimated_total_cost_rs", "total_cost_rs", "cost_source",
    "pdf_source", "page_first_seen", "audit_pdf_pages", "itens_fatura_json", "uploaded_file",
]
# What an export without a name is called, and the file-name words of an app export; an installation gives its own as parameters.
EXPORT_DEFAULT_NAME = "app_export"
APP_EXPORT_WORDS = ["filtered_flat", "app_export"]
CONTRACT_VERSION = "v1"
CONTRACT_COLUMNS = ["uc", "referencia", "kwh_total_te"]

# ---------------------------------------------------------------- rates and limits
ENERGY_RATE_RS_KWH = 0.85
DEMAND_RATE_RS_KW = 42.0
PEAK_THRESHOLD_PCT = 25.0
SUN_HOURS = 4.9
PERFORMANCE_RATIO = 0.80
DAYS_PER_MONTH = 30.0
CAPEX_RS_PER_MWP = 8_500_000.0
DC_AC_MIN, DC_AC_MAX = 1.05, 1.40
STC_TEMP_C = 25.0
MIN_AMBIENT_C = 0.0
MAX_CELL_C = 45.0 + 20.0
YIELD_SCENARIOS = [("Conservador", 1250), ("Base", 1350), ("Otimista", 1450)]
SCENARIO_NAMES = ["Scenario A", "Scenario B", "Scenario C"]
SCENARIO_DEFAULTS = {
    "dc_ac_ratio": 1.20, "modules_per_string": 28, "strings_per_combiner": 24, "spare_factor": 1.05,
}
SCALING_RULES = ["fixed", "per_mwp_ac", "per_kwp_dc", "per_string", "percent_of_capex"]
ALWAYS_ON_LOOKUPS = ["pv.modules_dc_kwp", "pv.inverter_qty"]
DEFAULT_REFERENCE_MWP = 30.0
QUALITY_NONPOSITIVE_LIMIT = 0.30
QUALITY_CLASSES = ["B3", "IP", "A4"]

# ---------------------------------------------------------------- abbreviations
# No meaning contains another abbreviation as a whole word, so the order of
# replacement does not matter.
ABBREVIATIONS = {
    "UFV": "Usina Fotovoltaica",
    "B3": "Grupo B3",
    "B4A": "Grupo B4A",
    "A4": "Grupo A4 (media tensao)",
    "HP": "Horario de Ponta",
    "FHP": "Fora de Horario de Ponta",
    "IP": "Iluminacao Publica",
    "UC": "Unidade Consumidora",
    "AC": "Corrente Alternada",
    "DC": "Corrente Continua",
    "kWh": "Quilowatt-hora",
    "kWp": "Quilowatt-pico",
    "MWp": "Megawatt-pico",
    "HSP": "Horas de Sol Pleno",
    "PR": "Performance Ratio",
    "MPPT": "Maximum Power Point Tracking",
    "STC": "Condicoes Padrao de Teste",
    "CAPEX": "Investimento Inicial",
    "OPEX": "Custo Operacional",
    "BOS": "Balance of System",
    "BDI": "Bonificacao e Despesas Indiretas",
}

# ---------------------------------------------------------------- catalog columns
MODULE_TEXT = ["model", "brand", "supplier", "notes", "pricing_version"]
MODULE_NUMBERS = ["wp", "vmp", "voc", "temp_coeff_voc", "price_sem_bdi_per_kwp", "price_com_bdi_per_kwp"]
MODULE_COLUMNS = [
    "model", "brand", "wp", "vmp", "voc", "temp_coeff_voc", "price_sem_bdi_per_kwp",
    "price_com_bdi_per_kwp", "supplier", "notes", "pricing_version",
]
INVERTER_NUMBERS = ["kw", "mppt_min_v", "mppt_max_v", "price_sem_bdi", "price_com_bdi"]
INVERTER_COLUMNS = [
    "model", "brand", "kw", "mppt_min_v", "mppt_max_v", "price_sem_bdi", "price_com_bdi",
    "supplier", "notes", "pricing_version",
]
BOS_QUANTITIES = ["base_qty_per_mwp", "base_qty_per_kwp", "base_qty_fixed", "base_qty_per_string"]
BOS_COLUMNS = [
    "item_code", "item_name", "unit", "base_qty_per_mwp", "base_qty_per_kwp", "base_qty_fixed",
    "base_qty_per_string", "unit_price_sem", "unit_price_com", "bdi_rule", "scaling_rule",
]
PRICING_VERSION_COLUMNS = ["version_id", "date", "description", "source"]
CATALOG_KEY = ["model", "supplier", "pricing_version"]
LOCATION_COLUMNS = ["ibge_code", "city", "state_uf", "state_name", "city_search"]
AUDIT_LOG_COLUMNS = [
    "timestamp", "user", "project", "version", "scenario_name", "excel_file", "snapshot_file",
]

# ---------------------------------------------------------------- month tokens in text
MON3 = "JAN|FEV|MAR|ABR|MAI|JUN|JUL|AGO|SET|OUT|NOV|DEZ"
MONTH_TOKEN = r"[A-Z]{3}[/-]?\d{2,4}|(?:0?[1-9]|1[0-2])[/-]\d{2,4}|\d{6}"
FREE_MONTH_TOKEN = r"\b(?:[A-Z]{3}[/-]?\d{2,4}|(?:0?[1-9]|1[0-2])[/-]\d{2,4})\b"
HISTORY_MONTH = rf"\b(?:(?:{MON3})[/\-]?\d{{2,4}}|(?:0?[1-9]|1[0-2])[/\-]\d{{2,4}})\b"
DISCOVERY_MONTH = rf"\b(?:{MON3})\s*/\s*\d{{2,4}}\b|\b(?:0?[1-9]|1[0-2])/\d{{4}}\b"
LONG_MONTH_REF = r"\b(" + "|".join(LONG_MONTH_NUMBER) + r")\s*/\s*(\d{4})\b"
SHORT_MONTH_REF = rf"\b({MON3})\s*/\s*(\d{{2,4}})\b"
LABELLED_REFERENCE = [
    rf"\bREFERENCIA\b\s*[:\-]?\s*({MONTH_TOKEN})\b",
    rf"\bMES\s*/?\s*ANO\b\s*[:\-]?\s*({MONTH_TOKEN})\b",
    rf"\bCOMPETENCIA\b\s*[:\-]?\s*({MONTH_TOKEN})\b",
]

# ---------------------------------------------------------------- labelled fields (raw text, any case)
UC_LABELS = {
    "UC": r"\bUC:\s*([0-9]{6,12})\b",
    "INSTALACAO": r"\bInstala[cç][aã]o:\s*([0-9]{6,12})\b",
    "UNIDADE_CONSUMIDORA": r"\bUnidade\s+Consumidora:\s*([0-9]{6,12})\b",
    "NUMERO_CLIENTE": r"\bN[uú]mero\s+(?:do\s+)?Cliente:\s*([0-9]{6,12})\b",
}
# A line that is one number, the words that stand by a unit's number, and numbers that are dates, months or money.
ID_LINE = r"^[^0-9A-Za-z]*([0-9](?:[0-9./ -]*[0-9])?)[^0-9A-Za-z]*$"
ID_LABEL = r"\bUC\b|\bUNIDADE CONSUMIDORA\b|\bINSTALACAO\b|\bCODIGO D[AO] (?:CLIENTE|UC|INSTALACAO)\b|\bNUMERO (?:DO )?CLIENTE\b"
NOT_AN_ID = r"^\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}$|^\d{1,2}/\d{4}$"
REFERENCE_LABELS = {
    "REFERENCIA": r"\bRefer[êe]ncia:\s*(\d{2}/\d{4})\b",
    "MES_ANO": r"\bM[eê]s/Ano:\s*(\d{2}/\d{4})\b",
    "FATURA_YYYYMM": r"\bFatura:\s*(\d{6})[-/]\d+\b",
    "DATA_FATURAMENTO": r"\bData\s*Faturamento:\s*(\d{2}/\d{2}/\d{4})\b",
    "PERIODO_REFERENCIA": r"\bPer[ií]odo\s*(?:de\s*)?Refer[eê]ncia:\s*(\d{2}/\d{4})\b",
}
GROUP_LABEL = r"\bGrupo\s*/\s*Subgrupo\s*Tens[aã]o:\s*([AB])\s*-\s*([A-Z0-9]+)\b"
SUBGROUP_LABEL = r"\bSubgrupo:\s*([AB]\d[A-Za-z]?)\b"
CLASS_LABELS = {
    "CLASSIFICACAO_HEADER": r"(?s)\bClassifica[cç][aã]o\s*/\s*Modalidade\s*Tarif[aá]ria\s*/\s*Tipo\s*de\s*Fornecimento:\s*(.+?)\bMunic[ií]pio:",
    "CLASSE_CONSUMO": r"\bClasse\s+(?:de\s+)?Consumo:\s*(.+?)(?:\n|$)",
    "MODALIDADE": r"\bModalidade\s+Tarif[aá]ria:\s*(.+?)(?:\n|$)",
}
CLASS_ASCII = r"\bCLASSIFICACAO\s*/\s*MODALIDADE\s*TARIFARIA\s*/\s*TIPO\s*DE\s*FORNECIMENTO:\s*(.+?)(?:\bMUNICIPIO:|\bORIGEM:|$)"
ORIGIN_LABEL = r"\bOrigem:\s*([A-Za-zÀ-ÿ ]{0,40})\b"
NAME_LABELS = [
    r"(?s)\bNome:\s*(.+?)\bEndere[cç]o:",
    r"(?s)\bNome:\s*(.+?)(?:\bEndere[cç]o:|\bMunic[ií]pio:|\bOrigem:|\bGrupo\s*/\s*Subgrupo|\bClassifica|$)",
]
ADDRESS_LABELS = [
    r"(?s)\bEndere[cç]o:\s*(.+?)\bEtapa:",
    r"(?s)\bEndere[cç]o:\s*(.+?)(?:\bEtapa:|\bMunic[ií]pio:|\bOrigem:|\bGrupo\s*/\s*Subgrupo|\bClassifica|$)",
]
TOTAL_LABELS = [
    r"\bValor:\s*R\$\s*([0-9][0-9\.\,]*)\b",
    r"\bTotal\s+a\s+Pagar(?:\s*\(R\$\))?\s*:?\s*R?\$?\s*([0-9][0-9\.\,]*)\b",
    r"\bValor\s+Total\s*:?\s*R\$\s*([0-9\.\,]+)",
    r"\bTotal\s+(?:da\s+)?Fatura\s*:?\s*R\$\s*([0-9\.\,]+)",
]
DUE_LINE = rf"\b({MONTH_TOKEN})\s+\d{{2}}/\d{{2}}/\d{{4}}\s+R\$\s*([0-9][0-9\.,]*)\b"
DUE_TOTAL_FALLBACKS = [
    r"\bVALOR\s+A\s+PAGAR\b[\s:R\$]*([0-9][0-9\.,]*)\b",
    r"\bTOTAL\b[\s:R\$]*([0-9][0-9\.,]*)\b",
]

# ---------------------------------------------------------------- kWh and demand
QTY_AFTER_LABEL = r"\b(?:\s+[A-Z/%()\-]+){0,3}\s+([0-9]{1,3}(?:\.[0-9]{3})*(?:,[0-9]+)?|[0-9]+(?:,[0-9]+)?)\b"
KWH_ITEM_PATTERNS = {
    "ITEM_CONSUMO_IP_TE_QTD": r"\bCONSUMO\s+IP\s+TE" + QTY_AFTER_LABEL,
    "ITEM_CONSUMO_TE_QTD": r"\bCONSUMO\s+TE" + QTY_AFTER_LABEL,
    "ITEM_ENERGIA_UNICO_QTD": r"\bENERGIA\s+UNICO" + QTY_AFTER_LABEL,
}
KWH_TEXT_PATTERNS = {
    "CONS_IP_TE": r"\bConsumo\s+IP\s+TE\b[\s:]+([0-9\.\,]+)\b",
    "CONS_IP_GENERIC": r"\bConsumo\s+IP\b[\s\S]{0,60}?\bTE\b[\s:]+([0-9\.\,]+)\b",
    "CONS_TE": r"\bConsumo\s*TE\b[\s:]+([0-9\.\,]+)\b",
    "ENERGIA_TE": r"\bEnergia\s*TE\b[\s:]+([0-9\.\,]+)\b",
    "ENERGIA_ATIVA": r"\bEnergia\s+Ativa\b[\s:]+([0-9\.\,]+)",
    "ENERGIA_ELETRICA": r"\bEnergia\s+El[eé]trica\b[\s:]+([0-9\.\,]+)",
    "CONSUMO_KWH": r"\bConsumo\s*\(?kWh\)?\s*:?\s*([0-9\.\,]+)",
}
KWH_GENERIC_PATTERNS = {
    "ENERGIA_UNICO_APURADO": r"(?s)\bEnergia\s+Único\b.*?\bApurado\b\s+([0-9\.\,]+)\b",
    "KWH_GENERIC": r"\bkWh\b\s*([0-9\.\,]+)\b",
    "KWH_BROKEN": r"\bkW\s*h\b\s*([0-9\.\,]+)\b",
}
A4_ENERGY_PATTERNS = {
    "fhp": r"\bConsumo\s*Fora\s*Ponta\s*TE\b[\s:]+([0-9\.\,]+)\b",
    "hp": r"\bConsumo\s*Ponta\s*TE\b[\s:]+([0-9\.\,]+)\b",
}
DEMAND_PATTERNS = {
    "DEMANDA_ITEM": r"\bDemanda\b[\s\S]{0,40}?\bQuantidade\b[\s:]+([0-9\.\,]+)\b",
    "DEMANDA_CONTRATADA": r"\bDemanda\s+Contratada\b[\s:]+([0-9\.\,]+)",
    "DEMANDA_REGISTRADA": r"\bDemanda\s+Registrada\b[\s:]+([0-9\.\,]+)",
    "DEMANDA_MEDIDA": r"\bDemanda\s+Medida\b[\s:]+([0-9\.\,]+)",
}
DEMAND_DIFFERENCE = r"\bDiferen[cç]a\s+da\s+Demanda\s+Contratad[aã]\b[\s:]+([0-9\.\,]+)\b"
ROBUST_DEMAND = r"\bDEMANDA\b(?!\s*(?:FORA|PONTA|DE))\s*([0-9][0-9\.,]*)"
ROBUST_DEMAND_DIFFERENCE = r"\b(?:DIFERENCA\s+DA\s+DEMANDA\s+CONTRATAD\w*|DEMANDA\s+DE\s+ULTRAPASSAGEM)\b\s*([0-9][0-9\.,]*)"
BARE_DEMAND = [
    r"\bDEMANDA\b(?!\s+(?:DE|FORA|PONTA|HORARIA|NAO|CONTRATAD))(?:\s*[-:]\s*|\s+)([0-9][0-9\.,]*)",
    r"\bDEMANDA\b(?!\s+(?:DE|FORA|PONTA|HORARIA|NAO|CONTRATAD))(?:\s+[A-Z/%()\-]+){0,1}\s+([0-9][0-9\.,]*)",
]
CONTRACTED_IN_SECTION = [
    r"\bDEMANDA\s+FORA\s+PONTA\s*-\s*KW\b(?:\s*[:\-])?\s*([0-9][0-9\.,]*)\b",
    r"\bDEMANDA\s+FORA\s+PONTA\s+KW\b(?:\s*[:\-])?\s*([0-9][0-9\.,]*)\b",
]
CONTRACTED_LINE = r"DEMANDA\s+FORA\s+PONTA\s*-\s*KW\s*([0-9\.,]+)"
CONTRACTED_ROWS = [
    r"\bDEMANDA\s+ATIVA\s+KW\b\s+([0-9][0-9\.,]*)\b",
    r"\bDEMANDA\s+FATURADA\s*-\s*KW\b[\s:]+([0-9][0-9\.,]*)\b",
    r"\bDEMANDA\s+KW\b\s+([0-9][0-9\.,]*)\b",
]
B_QUANTITY_LABELS = ["CONSUMO TE", "CONSUMO IP TE", "CONSUMO UNICO TE", "ENERGIA UNICO TE"]
A4_QUANTITY_LABELS = {
    "demanda_fhp_kw": ["DEMANDA FORA PONTA", "DEMANDA HORARIA FORA PONTA"],
    "demanda_ultrapassagem_kw": [
        "DEMANDA DE ULTRAPASSAGEM", "DIFERENCA DA DEMANDA CONTRATADA", "DIFERENCA DA DEMANDA CONTRATAD",
    ],
    "demanda_nao_utilizada_kw": ["DEMANDA NAO UTILIZADA", "DEMANDA NAO UTILIZADA FORA PONTA"],
    "consumo_hp_kwh": ["CONSUMO PONTA TE", "CONSUMO PONTA"],
    "consumo_fhp_kwh": [
        "CONSUMO FORA PONTA TE", "CONSUMO HORARIA FORA PONTA TE", "CONSUMO FORA PONTA",
        "CONSUMO UNICO TE", "CONSUMO UNICO",
    ],
}
TWO_TAB_LABELS = {
    "demanda_kw": ["DEMANDA", "DEMANDA CONTRATADA", "DEMANDA MEDIDA", "DEMANDA KW"],
    "ultrapassagem_kw": [
        "ULTRAPASSAGEM", "ULTRAPASSAGEM DEMANDA", "DIFERENCA DA DEMANDA CONTRATADA",
        "DIFERENCA DA DEMANDA CONTRATAD",
    ],
    "consumo_te_ponta": ["CONSUMO TE PONTA", "CONSUMO PONTA TE", "CONSUMO NA PONTA", "CONSUMO PONTA"],
    "consumo_te_fora_ponta": [
        "CONSUMO TE FORA PONTA", "CONSUMO FORA PONTA TE", "CONSUMO FORA DA PONTA", "CONSUMO FORA PONTA",
    ],
    "consumo_te": ["CONSUMO TE"],
}

# ---------------------------------------------------------------- sections and headers
ITEMS_SECTION_START = r"\bITENS?\s+(?:DA|DE)\s+FATURA\b"
ITEMS_SECTION_END = [
    "VALORES MEDIDOS", "HISTORICO", "NOVO MODELO DE NOTA FISCAL", "MES/ANO",
    "INFORMACOES COMPLEMENTARES", "INFORMACOES IMPORTANTES", "RESERVADO AO FISCO",
]
CONTRACTED_SECTION_START = r"\bGRANDEZA(?:S)?\s+CONTRATADA(?:S)?\b"
CONTRACTED_SECTION_END = [
    "ITENS DE FATURA", "ITENS DA FATURA", "HISTORICO", "VALORES MEDIDOS", "DETALHAMENTO DA CONTA",
    "INFORMACOES COMPLEMENTARES", "INFORMACOES IMPORTANTES", "RESERVADO AO FISCO",
]
HEADER_END = ["ITENS DE FATURA", "DESCRICAO DO FATURAMENTO", "MES/ANO", "MEDIDOR GRANDEZAS", "HISTORICO"]
HEADER_CLASS_LINES = [r"\bA4\b.*\bHOROSAZONAL\b", r"\bB3\b", r"\bB4[AB]?\b|ILUMINACAO PUBLICA"]
ITEM_LABELS = [
    "DEMANDA DE ULTRAPASSAGEM",
    "DIFERENCA DA DEMANDA CONTRATADA",
    "DIFERENCA DA DEMANDA CONTRATAD",
    "DEMANDA NAO UTILIZADA FORA PONTA",
    "DEMANDA NAO UTILIZADA",
    "DEMANDA HORARIA FORA PONTA",
    "DEMANDA FORA PONTA",
    "CONSUMO HORARIA FORA PONTA TUSD",
    "CONSUMO HORARIA FORA PONTA TE",
    "CONSUMO FORA PONTA TUSD",
    "CONSUMO FORA PONTA TE",
    "CONSUMO PONTA TUSD",
    "CONSUMO PONTA TE",
    "CONSUMO IP TE",
    "CONSUMO TUSD",
    "CONSUMO TE",
    "ENERGIA UNICO",
    "DEMANDA",
]
ITEM_TAIL_CHARS = 220
ITEM_NUMBER = r"-?[0-9]{1,3}(?:\.[0-9]{3})*(?:,[0-9]+)?|-?[0-9]+(?:,[0-9]+)?"
PLAIN_NUMBER = r"([0-9][0-9\.,]*)"
ENERGY_ROW_PERIOD = (
    r"\bENERGIA\s+(?:ATV|ATIVA)\s+(?:FORN|FORNECIDA)\s+(F\s*PONTA|FORA\s+PONTA|PONTA)\s+"
    r"(TE|TUSD)\s+K\s*W\s*H\s*" + PLAIN_NUMBER + r"\s+" + PLAIN_NUMBER + r"\s+" + PLAIN_NUMBER
)
ENERGY_ROW_SINGLE = (
    r"\bENERGIA\s+(?:ATV|ATIVA)\s+(?:FORN|FORNECIDA)\s+(TE|TUSD)\s+K\s*W\s*H\s*"
    + PLAIN_NUMBER + r"\s+" + PLAIN_NUMBER + r"\s+" + PLAIN_NUMBER
)

# ---------------------------------------------------------------- history rows
HISTORY_NUMBER = r"\d+(?:\.\d{3})*(?:,\d+)?"
HISTORY_SERIES = {
    "demanda_hp_kw": r"\bDEMANDA\s+(?:HP|PONTA)\b",
    "demanda_fhp_kw": r"\bDEMANDA\s+(?:FHP|FORA\s+PONTA)\b",
    "consumo_hp_kwh": r"\bCONSUMO\s+(?:HP|PONTA)\b",
    "consumo_fhp_kwh": r"\bCONSUMO\s+(?:FHP|FORA\s+PONTA)\b",
}
B_HISTORY_LINES = [
    rf"^\s*((?:{MON3})/\d{{2,4}})\s+([0-9][0-9\.,]*)\s*(?:[0-9]{{1,3}})?\s*$",
    rf"^\s*((?:{MON3})\d{{2,4}})\s+([0-9][0-9\.,]*)\s+[0-9]{{1,3}}\s+(?:LID|MIN)\s*$",
    r"^\s*((?:0?[1-9]|1[0-2])[/\-]\d{2,4})\s+([0-9][0-9\.,]*)\s*(?:[0-9]{1,3})?\s*$",
]
B_HISTORY_STREAM = [
    rf"\b((?:{MON3})/\d{{2,4}})\s+([0-9][0-9\.,]*)\s+[0-9]{{1,3}}\b",
    rf"\b((?:{MON3})\d{{2,4}})\s+([0-9][0-9\.,]*)\s+[0-9]{{1,3}}\s+(?:LID|MIN)\b",
    r"\b((?:0?[1-9]|1[0-2])[/\-]\d{2,4})\s+([0-9][0-9\.,]*)\s+[0-9]{1,3}\b",
]
SPLIT_LINE_MONTH = rf"\b(?:{MON3})\s*/\s*\d{{2,4}}\b"
SPLIT_LINE_NUMBER = r"-?\d[\d\.,]*"
A4_HISTORY_LINE = (
    rf"^\s*((?:{MON3})[/\-]?\d{{2,4}}|(?:0?[1-9]|1[0-2])[/\-]\d{{2,4}})\s+"
    r"([0-9][0-9\.,]*)\s+([0-9][0-9\.,]*)\s+([0-9][0-9\.,]*)\s+([0-9][0-9\.,]*)(?:\s+[0-9]{1,3})?\s*$"
)

# ---------------------------------------------------------------- pages without a UC label
UNLABELLED_ID_PATTERNS = [
    r"\bNO\s+DO\s+CLIENTE\b[^0-9]{0,30}([0-9]{4,12})\b",
    r"\bUNIDADE\s+CONSUMIDORA\b[^0-9]{0,30}([0-9]{4,12})\b",
    r"\bINSTALACAO\b[^0-9]{0,30}([0-9]{4,12})\b",
    r"\bCODIGO\s+([0-9]{4,12})\b",
    r"\b([0-9]{4,12})\s+NOTA\s+FISCAL\b",
    r"^\s*([0-9]{4,12})\b.*\bCFOP\b",
]
STREET_PREFIX = r"^(?:RUA|R\b|AV\b|AVENIDA|ESTRADA|EST\b|RODOVIA|ROD\b|PRACA|PCA\b|TRAVESSA|TV\b)\b"

# ---------------------------------------------------------------- grouped invoices
GROUPED_MARKER = r"\bCCI\b[^0-9]{0,20}[0-9]{4,12}\b"
GROUPED_PAGE_MARKERS = ["CCI", "DETALHAMENTO DA CONTA", "NEOENERGIA", "ELEKTRO"]
GROUPED_ID_PATTERNS = [r"\bUC\s*:\s*([0-9]{3,12})\b", r"\bCCI\b[^0-9]{0,20}([0-9]{3,12})\b"]
GROUPED_ID_FOOTER = r"\bSEU\s+CODIGO\b[\s\S]{0,200}\b([0-9]{6,12})\b"
GROUPED_ISSUE_DATE = r"\bDATA\s+DE\s+EMISSAO\s*:\s*(\d{2}/\d{2}/\d{4})\b"
GROUPED_NAME = r"\bNOME\s*:\s*(.+?)(?:\bENDERECO\b|$)"
GROUPED_ADDRESS = r"\bENDEREC[OÇ]\s*:\s*(.+?)(?:\bCCI\b|$)"
GROUPED_NOT_A_NAME = [
    "DATA DE EMISSAO", "DATA DE APRESENTACAO", "CNPJ/CPF", "CONTROLE", "SEU CODIGO",
]
GROUPED_ADDRESS_END = [
    "DATA DE EMISSAO", "DATA DE APRESENTACAO", "CNPJ/CPF", "CONTROLE N", "DESCRICAO DO PRODUTO",
    "SEU CODIGO", "FATURA AGRUPADA", "GBELEKTRO",
]
GROUPED_ISSUE_TAIL = r"\bData\s+de\s+Emiss[aã]o\s*:.*$"
GROUPED_TOTAL = r"\bTOTAL\s+A\s+PAGAR\b[\s:R\$]*([0-9][0-9\.,]*)"
GROUPED_MONEY = r"R\$\s*([0-9]{1,3}(?:\.[0-9]{3})*,[0-9]{2})"
GROUPED_TOTAL_LINE = r"(?m)^TOTAL\b[^\n]*?([0-9]{1,3}(?:\.[0-9]{3})*,[0-9]{2})\s*$"
GROUPED_TE_ROW = (
    r"\b(?:CONSUMO(?:\s+[A-Z]+){0,4}|CUSTO\s+DISP\s+SISTEMA)\s+TE\b"
    r"(?:\s+[A-Z/%()\-]+){0,3}\s+([0-9][0-9\.,]*)\b"
)
GROUPED_TEXT_SOURCES = ["CONS_IP_TE", "CONS_IP_GENERIC", "CONS_TE", "ENERGIA_TE"]

# ---------------------------------------------------------------- invoice layouts
# For each layout: sets of markers that are all required, and inside a set the
# alternatives of which one is enough. Layouts and sets are tried in order.
LAYOUT_RULES = [
    ("CELESC_COLETIVA", [["RELACAO DE UCS DA COLETIVA"], ["ITENS DA FATURA", "ITENS DE FATURA"]]),
    ("CELESC_COLETIVA", [["CELESC"], ["ITENS DA FATURA", "ITENS DE FATURA"]]),
    ("ENEL_A4", [["DOCUMENTO AUXILIAR DA NOTA FISCAL"],
                 ["ITENS DE FATURA", "MES/ANO", "HISTORICO DO FATURAMENTO"]]),
    ("ENEL_A4", [["ENEL", "AMPLA"], ["MES/ANO", "HISTORICO DO FATURAMENTO"]]),
    ("NEOENERGIA_ELEKTRO", [["NEOENERGIA", "ELEKTRO", "CCI*", "<word CCI>"],
                            ["DESCRICAO DO PRODUTO", "DETALHAMENTO DA CONTA"]]),
    ("CPFL", [["CPFL", "RGE"], ["ITENS DA FATURA", "ITENS DE FATURA", "DESCRICAO DO FATURAMENTO",
                                "DESCRICAO DO PRODUTO"]]),
    ("CEMIG", [["CEMIG"], ["CONTA DE ENERGIA", "ITENS DE FATURA", "DESCRICAO DO FATURAMENTO"]]),
    ("COPEL", [["COPEL"], ["ITENS DA FATURA", "DESCRICAO DO FATURAMENTO"]]),
    ("EQUATORIAL", [["EQUATORIAL"], ["ITENS", "FATURA", "DESCRICAO DO FATURAMENTO"]]),
    ("ENERGISA", [["ENERGISA"], ["ITENS", "FATURA", "DESCRICAO DO FATURAMENTO"]]),
    ("LIGHT", [["LIGHT"], ["ELETRICIDADE", "LIGHT S"]]),
    ("COELBA", [["COELBA", "COSERN", "<NEOENERGIA without ELEKTRO>"]]),
]
# Fallback: the layout with most markers wins when it has at least two; ties go
# to the earlier layout.
LAYOUT_MARKERS = [
    ("CELESC_COLETIVA", ["RELACAO DE UCS DA COLETIVA", "ITENS DA FATURA", "UC:"]),
    ("ENEL_A4", ["DOCUMENTO AUXILIAR DA NOTA FISCAL", "ITENS DE FATURA", "MES/ANO"]),
    ("NEOENERGIA_ELEKTRO", ["CCI", "DESCRICAO DO PRODUTO", "GBELEKTRO"]),
    ("CPFL", ["CPFL", "DISTRIBUIDORA", "ITENS DA FATURA"]),
    ("CEMIG", ["CEMIG", "DISTRIBUICAO S.A", "CONTA DE ENERGIA"]),
    ("COPEL", ["COPEL", "COMPANHIA PARANAENSE", "DESCRICAO DO FATURAMENTO"]),
    ("EQUATORIAL", ["EQUATORIAL", "EQUATORIAL ENERGIA", "FATURA"]),
    ("ENERGISA", ["ENERGISA", "CONTA DE ENERGIA", "FATURA"]),
    ("LIGHT", ["LIGHT", "SERVICOS DE ELETRICIDADE", "FATURA"]),
    ("COELBA", ["COELBA", "NEOENERGIA COELBA", "FATURA"]),
]
KNOWN_ITEM_HEADERS = [
    "ITENS DA FATURA", "ITENS DE FATURA", "ITENS DE FATURA UNID QUANT", "CCI* DESCRICAO DO PRODUTO",
]

# ---------------------------------------------------------------- contract adapters
# Aliases in order of preference, per field, for the two families of adapters.
FIRST_FAMILY_ALIASES = {
    "municipio": ["municipio", "cidade"],
    "uc": ["uc", "unidade consumidora", "unidade_consumidora", "instalacao", "numero uc"],
    "consumer_class": ["classe", "subclasse", "grupo tarifario", "grupo_tarifario", "subgrupo",
                       "modalidade tarifaria", "tipo cliente"],
    "reference_date": ["reference_date", "data_referencia", "referencia", "competencia", "mes referencia"],
    "consumption_kwh": ["kwh_total_te", "itens_fatura_energia_kwh", "consumo_kwh", "energia_kwh", "kwh"],
    "demand_kw": ["demanda_kw", "demanda registrada", "demanda faturada", "demanda", "kw"],
    "source_file": ["source_file", "arquivo_origem", "arquivo"],
}
RULE_FAMILY_ALIASES = {
    "municipio": ["municipio", "cidade", "localidade"],
    "uc": ["uc", "instalacao", "unidade consumidora", "numero cliente"],
    "consumer_class": ["categoria", "classificacao_uc", "grupo tarifario", "subgrupo", "classe"],
    "reference_date": ["referencia", "reference_date", "competencia", "mes referencia"],
    "consumption_kwh": ["kwh_total_te", "itens_fatura_energia_kwh", "consumo_kwh", "energia_kwh"],
    "demand_kw": ["demanda_kw", "demanda registrada", "demanda faturada", "demanda contratada"],
    "source_file": ["source_file", "arquivo_origem", "pdf_source"],
}
RULE_FAMILY_CLASSES = [
    ("^ip$|iluminacao publica|^b4", "IP"),
    (r"a4|grupo a|alta tensao|\bmt\b|horosazonal", "A4"),
    ("b3|grupo b|comercial|convencional", "B3"),
]
FIRST_FAMILY_ADAPTERS = ["celesc", "cpfl", "enel"]
RULE_ADAPTER_HINTS = {
    "cemig": {"columns": ["cemig"], "content": ["cemig", "cemig distribuicao"]},
    "coelba": {"columns": ["coelba", "neoenergia"], "content": ["coelba", "neoenergia coelba", "cosern"]},
    "copel": {"columns": ["copel"], "content": ["copel", "companhia paranaense"]},
    "energisa": {"columns": ["energisa"], "content": ["energisa"]},
    "equatorial": {"columns": ["equatorial"], "content": ["equatorial", "equatorial energia"]},
    "light": {"columns": ["light"], "content": ["light", "servicos de eletricidade"]},
}
FIRST_FAMILY_SIGNATURE = ("celesc", ["uc", "referencia", "kwh_total_te", "categoria"])
DETECTION_TEXT_COLUMNS = ["origem", "source_file", "pdf_source", "fornecedor", "distribuidora"]
DETECTION_POINTS = {"signature": 1.5, "column": 1.5, "content": 2.0, "file": 1.0}
DETECTION_MIN_SCORE, DETECTION_MIN_GAP = 2.0, 0.5

# ---------------------------------------------------------------- municipal sizing
SIZING_ALIASES = {
    "municipio": ["municipio", "municipality", "cidade"],
    "uc": ["uc", "unidade consumidora", "unidade_consumidora", "instalacao"],
    "date": ["reference_date", "data_referencia", "referencia", "competencia", "mes referencia"],
    "class": ["categoria", "consumer_class", "classificacao_uc", "classificacao (categoria)",
              "grupo tarifario", "subgrupo", "tarifa", "tariff", "classe"],
    "b3_ip": ["kwh_b3_ip", "consumo te (kwh)", "consumo te", "itens_fatura_energia_kwh",
              "kwh_total_te", "kwh"],
    "a4_hp": ["consumo_hp_kwh", "kwh_a4_p_te", "consumo te ponta", "consumo ponta", "consumo hp",
              "consumo hora ponta"],
    "a4_fhp": ["consumo_fhp_kwh", "kwh_a4_fp_te", "consumo te fora ponta", "consumo fora ponta",
               "consumo fhp", "consumo hfp", "consumo unico"],
    "a4_total": ["kwh_total_te", "itens_fatura_energia_kwh", "kwh"],
}
SIZING_NO_PEAK_SPLIT = "A4 HP/FHP columns not found. Falling back to A4 total kWh as FHP."
TARIFF_PRICE_COLUMNS = {
    "blended": ["itens_fatura_preco_medio_rs_kwh", "itens_fatura_preco_all_in_blended_rs_kwh",
                "itens_fatura_preco_all_in_fhp_rs_kwh", "itens_fatura_preco_all_in_hp_rs_kwh"],
    "energy_value": ["itens_fatura_energia_valor_rs", "total_fatura_rs"],
    "energy_kwh": ["itens_fatura_energia_kwh", "kwh_total_te"],
    "b_weight": ["kwh_b3_ip", "itens_fatura_energia_kwh", "kwh_total_te"],
    "hp_price": ["itens_fatura_preco_all_in_hp_rs_kwh", "itens_fatura_preco_all_in_blended_rs_kwh",
                 "itens_fatura_preco_medio_rs_kwh"],
    "hp_weight": ["kwh_a4_p_te", "consumo_hp_kwh", "itens_fatura_energia_kwh"],
    "fhp_price": ["itens_fatura_preco_all_in_fhp_rs_kwh", "itens_fatura_preco_all_in_blended_rs_kwh",
                  "itens_fatura_preco_medio_rs_kwh"],
    "fhp_weight": ["kwh_a4_fp_te", "consumo_fhp_kwh", "itens_fatura_energia_kwh"],
}
UNKNOWN_CATEGORIES = ["", "OUTROS", "N/A", "NAN"]
#: The only advice for an export without rows.
NOTHING_EXTRACTED = "Sem dados de extração para análise."
