"""Fixed values of the sentence splitter: marks, abbreviations, particles and opening words."""

from __future__ import annotations

#: Marks that end a sentence wherever they stand, and those that may.
FULL = "。！？｡؟।॥۔"
PLAIN = ".!?…‼⁇⁈⁉"
#: Pairs of brackets and of quotation marks; a straight quote closes itself.
BRACKETS = {"(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "［": "］", "〔": "〕"}
QUOTES = {"“": "”", "„": "“", "«": "»", "‹": "›", "「": "」", "『": "』", "《": "》", "〈": "〉", '"': '"'}
CLOSING = set("”»›」』》〉)]}）】］〕\"*_’")

#: Abbreviations that never end a sentence, whatever follows.
NEVER = set(
    """vs cf e.g i.e approx fig figs sect sec eq eqs ch dept st sgt dr mr mrs prof gen col capt lt rev hon viz resp incl excl vol ed eds pp art approx
    z.b d.h u.a o.ä i.d.r s.o s.u abb abschn kap tab bd hrsg vgl bzw ca ggf evtl inkl exkl zzgl sog str geb
    p.ex env cf art chap éd fig mme m.m mlle
    p.ej aprox pág págs cap art dpto depto sr sra srta dra ud uds núm tel
    т.е т.к ок см рис стр табл гл им ул тыс прибл напр ср""".split()
)
#: Abbreviations before a number only.
NUMBERED = set("no nos nr v n p pag art nº op ver vers bl".split())
#: Abbreviations that end a sentence if a capital, a number or an opening mark follows.
EITHER = set("etc usw u.s u.k u.n a.m p.m ff f inc ltd co corp jr sr al est т.д т.п др пр ss n.b ps".split())
#: Words before a German ordinal number, and the months after one.
ORDINAL_BEFORE = set("am zum vom im dem den der das des die beim ab bis jeder jeden".split())
MONTHS = set("Januar Februar März April Mai Juni Juli August September Oktober November Dezember Jänner Jahrhundert".split())
GERMAN = r"\b(?:der|die|das|und|ist|nicht|auf|bis|wird|nach|zum|ein|für|mit|Der|Die|Das|Im|Seit)\b"
