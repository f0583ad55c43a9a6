"""Published comorbidity code lists and weights (fixed values), written without the dot.

Sources: Quan et al. 2005 (Charlson and Elixhauser ICD-10 code lists), Quan et al. 2011
(updated Charlson weights), van Walraven et al. 2009 (Elixhauser weights), Gilbert et al. 2018
(hospital frailty risk score). ``I60-I69`` stands for every code between the two ends.
"""

CHARLSON_CODES = {
    "ami": "I21 I22 I252",
    "chf": "I099 I110 I130 I132 I255 I420 I425-I429 I43 I50 P290",
    "pvd": "I70 I71 I731 I738 I739 I771 I790 I792 K551 K558 K559 Z958 Z959",
    "cevd": "G45 G46 H340 I60-I69",
    "dementia": "F00-F03 F051 G30 G311",
    "copd": "I278 I279 J40-J47 J60-J67 J684 J701 J703",
    "rheumd": "M05 M06 M315 M32-M34 M351 M353 M360",
    "pud": "K25-K28",
    "mld": "B18 K700-K703 K709 K713-K715 K717 K73 K74 K760 K762-K764 K768 K769 Z944",
    "diab": "E100 E101 E106 E108 E109 E110 E111 E116 E118 E119 E120 E121 E126 E128 E129 "
            "E130 E131 E136 E138 E139 E140 E141 E146 E148 E149",
    "diabwc": "E102-E105 E107 E112-E115 E117 E122-E125 E127 E132-E135 E137 E142-E145 E147",
    "hp": "G041 G114 G801 G802 G81 G82 G830-G834 G839",
    "rend": "I120 I131 N032-N037 N052-N057 N18 N19 N250 Z490-Z492 Z940 Z992",
    "canc": "C00-C26 C30-C34 C37-C41 C43 C45-C58 C60-C76 C81-C85 C88 C90-C97",
    "msld": "I850 I859 I864 I982 K704 K711 K721 K729 K765 K766 K767",
    "metacanc": "C77-C80",
    "aids": "B20-B22 B24",
}

CHARLSON_QUAN_WEIGHTS = {
    "ami": 0, "chf": 2, "pvd": 0, "cevd": 0, "dementia": 2, "copd": 1, "rheumd": 1, "pud": 0, "mld": 2,
    "diab": 0, "diabwc": 1, "hp": 2, "rend": 1, "canc": 2, "msld": 4, "metacanc": 6, "aids": 4,
}

ELIXHAUSER_CODES = {
    "aids": "B20-B22 B24",
    "alcohol": "F10 E52 G621 I426 K292 K700 K703 K709 T51 Z502 Z714 Z721",
    "carit": "I441-I443 I456 I459 I47-I49 R000 R001 R008 T821 Z450 Z950",
    "chf": "I099 I110 I130 I132 I255 I420 I425-I429 I43 I50 P290",
    "coag": "D65-D68 D691 D693-D696",
    "cpd": "I278 I279 J40-J47 J60-J67 J684 J701 J703",
    "dane": "D508 D509 D51-D53",
    "depre": "F204 F313-F315 F32 F33 F341 F412 F432",
    "drug": "F11-F16 F18 F19 Z715 Z722",
    "fed": "E222 E86 E87",
    "hypc": "I11-I13 I15",
    "hypothy": "E00-E03 E890",
    "hypunc": "I10",
    "ld": "B18 I85 I864 I982 K70 K711 K713-K715 K717 K72-K74 K760 K762-K769 Z944",
    "lymph": "C81-C85 C88 C96 C900 C902",
    "metacanc": "C77-C80",
    "obes": "E66",
    "ond": "G10-G13 G20-G22 G254 G255 G312 G318 G319 G32 G35-G37 G40 G41 G931 G934 R470 R56",
    "para": "G041 G114 G801 G802 G81 G82 G830-G834 G839",
    "pcd": "I26 I27 I280 I288 I289",
    "psycho": "F20 F22-F25 F28 F29 F302 F312 F315",
    "pvd": "I70 I71 I731 I738 I739 I771 I790 I792 K551 K558 K559 Z958 Z959",
    "rf": "I120 I131 N18 N19 N250 Z490-Z492 Z940 Z992",
    "rheumd": "L940 L941 L943 M05 M06 M08 M120 M123 M30 M310-M313 M32-M35 M45 M461 M468 M469",
    "solidtum": "C00-C26 C30-C34 C37-C41 C43 C45-C58 C60-C76 C97",
    "valv": "A520 I05-I08 I091 I098 I34-I39 Q230-Q233 Z952-Z954",
    "wloss": "E40-E46 R634 R64",
    "blane": "D500",
    "diabc": "E102-E108 E112-E118 E122-E128 E132-E138 E142-E148",
    "diabunc": "E100 E101 E109 E110 E111 E119 E120 E121 E129 E130 E131 E139 E140 E141 E149",
    "pud": "K257 K259 K267 K269 K277 K279 K287 K289",
}

ELIXHAUSER_VW_WEIGHTS = {
    "aids": 0, "alcohol": 0, "carit": 5, "chf": 7, "coag": 3, "cpd": 3, "dane": -2, "depre": -3, "drug": -7,
    "fed": 5, "hypc": 0, "hypothy": 0, "hypunc": 0, "ld": 11, "lymph": 9, "metacanc": 12, "obes": -4, "ond": 6,
    "para": 7, "pcd": 4, "psycho": 0, "pvd": 2, "rf": 5, "rheumd": 0, "solidtum": 4, "valv": -1, "wloss": 6,
    "blane": -2, "diabc": 0, "diabunc": 0, "pud": 0,
}

# Mild form -> severe form that replaces it.
CHARLSON_BEATEN_BY = {"diab": "diabwc", "mld": "msld", "canc": "metacanc"}
ELIXHAUSER_BEATEN_BY = {"hypunc": "hypc", "diabunc": "diabc", "solidtum": "metacanc"}

HFRS_POINTS = {
    "F00": 7.1, "G81": 4.4, "G30": 4.0, "I69": 3.7, "R29": 3.6, "N39": 3.2, "F05": 3.2, "W19": 3.2, "S00": 3.2,
    "R31": 3.0, "B96": 2.9, "R41": 2.7, "R26": 2.6, "I67": 2.6, "R56": 2.6, "R40": 2.5, "T83": 2.4, "S06": 2.4,
    "S42": 2.3, "E87": 2.3, "M25": 2.3, "E86": 2.3, "R54": 2.2, "Z50": 2.1, "F03": 2.1, "W18": 2.1, "Z75": 2.0,
    "F01": 2.0, "S80": 2.0, "L03": 2.0, "H54": 1.9, "E53": 1.9, "Z60": 1.8, "G20": 1.8, "R55": 1.8, "S22": 1.8,
    "K59": 1.8, "N17": 1.8, "L89": 1.7, "Z22": 1.7, "B95": 1.7, "L97": 1.6, "R44": 1.6, "K26": 1.6, "I95": 1.6,
    "N19": 1.6, "A41": 1.6, "Z87": 1.5, "J96": 1.5, "X59": 1.5, "M19": 1.5, "G40": 1.5, "M81": 1.4, "S72": 1.4,
    "S32": 1.4, "E16": 1.4, "R94": 1.4, "N18": 1.4, "R33": 1.3, "R69": 1.3, "N28": 1.3, "R32": 1.2, "G31": 1.2,
    "Y95": 1.2, "S09": 1.2, "R45": 1.2, "G45": 1.2, "Z74": 1.1, "M79": 1.1, "W06": 1.1, "S01": 1.1, "A04": 1.1,
    "A09": 1.1, "J18": 1.1, "J69": 1.0, "R47": 1.0, "E55": 1.0, "Z93": 1.0, "R02": 1.0, "R63": 0.9, "H91": 0.9,
    "W10": 0.9, "W01": 0.9, "E05": 0.9, "M41": 0.9, "R13": 0.8, "Z99": 0.8, "U80": 0.8, "M80": 0.8, "K92": 0.8,
    "I63": 0.8, "N20": 0.7, "F10": 0.7, "Y84": 0.7, "R00": 0.7, "J22": 0.7, "Z73": 0.6, "R79": 0.6, "Z91": 0.5,
    "S51": 0.5, "F32": 0.5, "M48": 0.5, "E83": 0.4, "M15": 0.4, "D64": 0.4, "L08": 0.4, "R11": 0.3, "K52": 0.3,
    "R50": 0.1,
}

# Disability and sensory impairment: ICD-10 categories of our own choosing, replaceable per call.
DISABILITY_CODES = {
    "frail": "R54 R26 R296 Z74 M625 R53 R64",
    "impaired_hearing": "H90 H91",
    "impaired_speech": "R47 F80",
    "impaired_vision": "H54",
    "ld_asd": "F70-F79 F84",
}
