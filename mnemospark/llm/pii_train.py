"""Offline training of the personal-information tagger.

``python -m mnemospark.llm.pii_train ORIGINALS EPISODES`` writes ``pii_model.npz`` beside
this file. Labelled spans come from a bounded sample of texts (``TEXTS``, drawn by Spark) and
of their segments (``SAMPLE`` per kind): rules of high precision mark the mentions in them,
and every marked segment is used again with each mention replaced by a newly made one of its
type, or by something that resembles one and is none, so that the model learns forms and
surroundings and not values. As many again are sentences of public form in five languages
around names, streets and numbers put together from syllables (:class:`Wide`), whose
vocabulary has next to nothing in common with that of the texts.
"""

from __future__ import annotations

import random
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np

from mnemospark.llm.charlstm import TAGS, Tagger, char_ids
from mnemospark.llm.pii import normalised, segments

#: Segments of the sample: those with a mention, and those without.
SAMPLE = 12000
#: Texts that the segments are taken from.
TEXTS = 80000
#: Made sentences of public form.
MADE = 26000
#: Plain segments that a made mention is put into, between any two words.
SPLICED = 9000
#: Characters of a training example at most; of longer segments a stretch is taken.
LONGEST = 160

# Parts of the names that occur in the texts, and some public ones for variety.
SURNAMES_ZH = "沈 欧阳 程 温 林 季 纪 韩 苏 上官 乔 顾 叶 黎 贺 宋 秦 陆 周 许".split()
GIVEN_ZH = "禾予珩砚湛榆桐沅疏芷蘅朗羡钧岚舟栩笙陌澈遥昀棠霁"
MORE_SURNAMES_ZH = "王 李 张 刘 陈 杨 赵 黄 吴 徐 孙 马 朱 胡 郭 何 高 罗 郑 梁 谢 唐 冯 邓 曹 彭 曾 田 董 司马 诸葛".split()
MORE_GIVEN_ZH = "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀霞平刚桂英华建国玉兰红文雪梅宇浩然欣怡子轩梓涵"
SCRIPTED_ZH = "玛莲娜·布拉克 莉丝贝·芬莫尔 西尔万·莫罗比 托比亚斯·维尔莫 奥斯卡·索恩比 伊内丝·奎尔达".split()
GIVEN = "Petra Ines Amara Silvan Oskar Juno Mateo Marlene Edmund Nora Corin Tobias Lisbet Thea Wilma Kasimir Anselm Jorun Ottilie Rufus".split()
MORE_GIVEN = "Anna John Mary Peter Laura Paul Emma Lukas Sofia Hugo Clara Diego Elena Martin Julia Karl Alice Henri Carmen Pablo Greta Otto Louise Victor".split()
FAMILY_HEAD = "Quill Tarn Dray Lark Hax Stell Pell Brack Fenn Vel Ember Garr Wick Thorn Morrow Osk".split()
FAMILY_TAIL = "castle brook wether low sby dale ingham field egard acker mont hurst by moor ström enko".split()
MORE_FAMILY = "Smith Miller Brown Schmidt Weber Keller Dubois Moreau Garcia Lopez Navarro Jensen Novak Rossi Kowalski Larsson Becker Martin Dupont Fischer".split()
STREETS = "Ninefold Way|Wickerby Row|Gull Terrace|Tinder Avenue|Pewter Hill|Juniper Court|Hollow Fern Close|Old Kiln Drive|Copperleaf Lane|Saltgrass Road|Marrow Street".split("|")
TOWNS = "Quillmere Saltgrass Emberfold Larkmoor Wickerby Tarnhollow".split()
SHORT = {"Road": "Rd", "Street": "St", "Avenue": "Ave", "Drive": "Dr", "Lane": "Ln", "Close": "Cl", "Terrace": "Ter", "Court": "Ct"}
STREETS_ZH = "荻花大道 旧窑胡同 蕨园西路 纸灯巷 九层弄 慢板街 松涛路".split()
CITIES_ZH = "砚州市 青梧市 霁川市 云栎市 盐草县".split()
DISTRICTS_ZH = "荻港区 松涛区 砚北区 南窑街道 渡口镇".split()

_STREETS = STREETS + [s.replace(a, b) + r"\.?" for s in STREETS for a, b in SHORT.items() if s.endswith(a)]
_HAN_NUMBER = "零〇一二三四五六七八九十百两"
_RULES: list[tuple[str, re.Pattern]] = [
    ("email", re.compile(r"[A-Za-z0-9_.+-]+(?:@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}| \(at\) [A-Za-z0-9-]+(?: \(dot\) [A-Za-z0-9-]+)+| at [A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)+)")),
    ("id_number", re.compile(r"(?<![\dA-Za-z+])(?:\d{6}[ -]?(?:19|20)\d{6}[ -]?\d{3}[\dXx]|\d{10} \d{7}[\dXx]|9\d\d[ -]?\d\d[ -]?\d{4}|[A-Z]{2} ?\d{3} ?\d{4})(?![\dA-Za-z-])")),
    ("phone", re.compile(
        r"(?<![0-9A-Za-z.+])(?:\(\+\d{1,3}\) ?\d[\d -]{7,13}\d|\+\d{1,3}[ -]?(?:\(?\d{1,4}\)?[ .-]?)?\d{2,5}(?:[ .-]?\d{2,5}){1,4}|\(\d{3}\) ?\d{3}[ .-]?\d{4}|(?:1[-. ])?\d{3}[-. ]\d{3}[-. ]\d{4}"
        r"|1[3-9]\d[ .-]?\d{4}[ .-]?\d{4}|0\d{2,3}[-/ ]\d{7,8}|07\d{3} ?\d{6})(?: ?ext\. ?\d{1,4})?(?![\d-])")),
    ("phone", re.compile(r"(?<=[^零〇一二三四五六七八九幺])[零〇一二三四五六七八九幺]{11}(?![零〇一二三四五六七八九])|^[零〇一二三四五六七八九幺]{11}(?![零〇一二三四五六七八九])")),
    ("address", re.compile(
        rf"(?:Flat \d+, ?)?\d{{1,4}}[A-Z]? (?:{'|'.join(_STREETS)})(?![A-Za-z])(?:, ?Apt \d+)?(?:,? (?:{'|'.join(TOWNS)})(?: [A-Z]{{2}}\d \d[A-Z]{{2}}| \d{{5}})?)?|(?:{'|'.join(s.upper() for s in STREETS)}) \d{{1,4}}")),
    ("address", re.compile(
        rf"\d{{1,4}}(?: bis)?, (?:rue|impasse|avenue|allée) (?:des|du|de la|de|d') ?\w+(?:, \d{{5}} \w+)?|(?:Calle|Avenida|Plaza) (?:del|de la|de) \w+,? \d{{1,4}}(?:, \d{{5}} \w+)?"
        rf"|(?:Farnweg|Kleine Ofengasse|Amselgrund) \d{{1,4}}[a-z]?(?:, \d{{5}} \w+)?")),
    ("address", re.compile(
        rf"(?:(?:{'|'.join(CITIES_ZH)}) ?)?(?:(?:{'|'.join(DISTRICTS_ZH)}) ?)?(?:{'|'.join(STREETS_ZH)}) ?(?:\d{{1,4}}|[{_HAN_NUMBER}]{{1,5}})号(?: ?-\d+号)?(?: ?\d+(?:栋|单元|楼|室)){{0,3}}")),
    ("name", re.compile("|".join(map(re.escape, SCRIPTED_ZH)) + "|[一-鿿]{2,5}·[一-鿿]{2,5}")),
]
_FAMILY = rf"(?:{'|'.join(FAMILY_HEAD)})e?(?:{'|'.join(FAMILY_TAIL)})"
_NAME_LATIN = re.compile(rf"(?<![A-Za-z.@_-])(?:(?:{'|'.join(GIVEN)})(?:-(?:{'|'.join(GIVEN)}))?(?: [A-Z]\.){{0,2}} {_FAMILY}|{_FAMILY}, (?:{'|'.join(GIVEN)}))(?![A-Za-z@_-])", re.I)
# a name of ideographs stands at the ends of a clause or in one of the surroundings it has in the texts
_NAME_ZH = re.compile(rf"(?:{'|'.join(SURNAMES_ZH)})[{GIVEN_ZH}]{{1,2}}")
_BEFORE_ZH = re.compile(r"(?:^|[^一-鿿]|叫|是|写|同事|碰到|本名|和|说)$")
_AFTER_ZH = re.compile(r"^(?:$|[^一-鿿]|说|辞职|了|吵|人很好|别笑)")


def label(text: str) -> list[tuple[int, int, str]]:
    """Mentions in a normalised segment; earlier rules win where spans overlap."""
    found: list[tuple[int, int, str]] = []

    def add(a: int, b: int, kind: str) -> None:
        if b > a and all(b <= x or a >= y for x, y, _ in found):
            found.append((a, b, kind))

    for kind, rule in _RULES:
        for m in rule.finditer(text):
            add(m.start(), m.end(), kind)
    for m in _NAME_LATIN.finditer(text):
        add(m.start(), m.end(), "name")
    for m in _NAME_ZH.finditer(text):
        if _BEFORE_ZH.search(text[: m.start()]) and _AFTER_ZH.search(text[m.end() :]):
            add(m.start(), m.end(), "name")
    return sorted(found)


class Maker:
    """New mentions of each type, and things that are none."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def family(self) -> str:
        if self.r.random() < 0.2:
            return self.r.choice(MORE_FAMILY)
        return self.r.choice(FAMILY_HEAD) + self.r.choice(["", "", "e"]) + self.r.choice(FAMILY_TAIL)

    def given(self) -> str:
        return self.r.choice(GIVEN if self.r.random() < 0.8 else MORE_GIVEN)

    def name_zh(self) -> str:
        r = self.r
        rare = r.random() < 0.25
        return r.choice(MORE_SURNAMES_ZH if rare else SURNAMES_ZH) + "".join(r.choice(MORE_GIVEN_ZH if rare else GIVEN_ZH) for _ in range(r.choice([1, 2, 2])))

    def name(self, like: str) -> str:
        r = self.r
        if re.search(r"[一-鿿]", like):
            return r.choice(SCRIPTED_ZH) if "·" in like and r.random() < 0.5 else self.name_zh()
        given, family = self.given(), self.family()
        if r.random() < 0.12:
            given += "-" + self.given()
        if r.random() < 0.25:
            given += f" {r.choice('ABCDEFGHIJKLMNOPRSTVW')}."
        roll = r.random()
        if roll < 0.12:
            return f"{family}, {given}"
        if roll < 0.24:
            return f"{given} {family.upper()}"
        if roll < 0.36:
            return f"{given} {family}".lower()
        return f"{given} {family}"

    def email(self) -> str:
        r = self.r
        user = r.choice([self.given().lower() + r.choice([".", "-", "_", ""]) + self.family().lower().replace("ö", "o") + r.choice(["", self.digits(2)]), self.given().lower() + self.digits(3), self.family().lower().replace("ö", "o") + "+" + r.choice(["list", "shop", "kiln", "news"]), "".join(r.choice(["ba", "ke", "lo", "mi", "zu", "ta", "ri", "no"]) for _ in range(4)), r.choice("abcdefghijklmnoprstw") + "_" + self.family().lower().replace("ö", "o")])
        host = r.choice(["example.com", "example.net", "example.org", "inbox.test", "mx.wickerby.test", "larkmoor.example", "mail.example", "post.example", f"{self.family().lower().replace('ö', 'o')}.{r.choice(['com', 'net', 'de', 'cn', 'org', 'fr', 'es'])}"])
        style = r.random()
        if style < 0.15:
            return f"{user} (at) {host.replace('.', ' (dot) ')}"
        if style < 0.25:
            return f"{user} at {host.replace('.', ' dot ')}"
        full = f"{user}@{host}"
        return full.upper() if style < 0.33 else full

    def phone(self) -> str:
        r, d = self.r, self.digits
        forms = [
            lambda: f"+1 {d(3)} 555 01{d(2)}", lambda: f"+1{d(3)}55501{d(2)}", lambda: f"({d(3)}) 555-01{d(2)}", lambda: f"{d(3)}-555-01{d(2)}", lambda: f"{d(3)}.555.01{d(2)}",
            lambda: f"1-{d(3)}-555-01{d(2)} ext. {d(2)}", lambda: f"+44 7700 900 {d(3)}", lambda: f"07700 900{d(3)}", lambda: f"+33 1 99 00 {d(2)} {d(2)}", lambda: f"030/23125{d(3)}",
            lambda: f"1{r.choice('345678')}{d(9)}", lambda: f"1{r.choice('345')}{d(1)} {d(4)} {d(4)}", lambda: f"1{r.choice('345')}{d(1)}-{d(4)}-{d(4)}", lambda: f"1{r.choice('345')}{d(1)}.{d(4)}.{d(4)}",
            lambda: f"+86 1{r.choice('345')}{d(9)}", lambda: f"(+86)1{r.choice('345')}{d(1)}-{d(8)}", lambda: f"0{d(3)}-{d(7)}", lambda: f"0{d(2)}-{d(8)}", lambda: f"+49 {d(3)} {d(7)}", lambda: f"+34 {d(3)} {d(3)} {d(3)}",
            lambda: "幺" + "".join(r.choice("零一二三四五六七八九幺") for _ in range(10)), lambda: f"{d(3)} 555 01{d(2)}",
        ]
        return r.choice(forms)()

    def id_number(self) -> str:
        r, d = self.r, self.digits
        day = f"{r.choice([19, 20])}{d(2)}{r.randint(1, 12):02d}{r.randint(1, 28):02d}"
        last = d(3) + r.choice("0123456789X")
        area = ("99" if r.random() < 0.7 else d(2)) + d(4)
        forms = [lambda: area + day + last, lambda: f"{area} {day} {last}", lambda: f"{area}-{day}-{last}", lambda: f"9{d(2)}-{d(2)}-{d(4)}", lambda: f"9{d(2)} {d(2)} {d(4)}", lambda: f"9{d(8)}",
                 lambda: f"XZ{d(7)}", lambda: f"XZ {d(3)} {d(4)}", lambda: f"{r.choice('ABCDEFGHKL')}{r.choice('PRSTUVXYZ')}{d(7)}", lambda: f"{area}{day[:4]} {day[4:]}{last}"]
        return r.choice(forms)()

    def address(self, like: str) -> str:
        r, d = self.r, self.digits
        number = str(r.randint(1, 399))
        if re.search(r"[一-鿿]", like):
            street = r.choice(STREETS_ZH) if r.random() < 0.7 else r.choice("云松梅兰竹清和平安康宁东西南北新华") + r.choice("云松梅兰竹清和平安康宁东西南北新华") + r.choice(["路", "街", "巷", "弄", "大道"])
            head = r.choice(["", "", r.choice(CITIES_ZH), r.choice(CITIES_ZH) + r.choice(DISTRICTS_ZH)])
            if r.random() < 0.12:
                number = "".join(r.choice("一二三四五六七八九") for _ in range(3))
            gap = " " if r.random() < 0.1 else ""
            tail = r.choice(["", f"-{r.randint(1, 9)}号", f"{r.randint(1, 20)}栋{r.randint(1, 9)}0{r.randint(1, 9)}室", f"{r.randint(1, 6)}单元{r.randint(1, 20)}楼"])
            return f"{head}{gap}{street}{gap}{number}号{gap if tail else ''}{tail}"
        if re.search(r"rue|impasse|avenue |allée", like):
            return r.choice([f"{number}, rue des {r.choice(['Fougères', 'Lilas', 'Tilleuls'])}", f"{number} bis, impasse du {r.choice(['Levain', 'Four'])}, {d(5)} {r.choice(TOWNS)}", f"{number}, avenue de la {r.choice(['Gare', 'Paix'])}"])
        if re.search(r"Calle|Avenida", like):
            return r.choice([f"Calle del {r.choice(['Horno', 'Sol', 'Pozo'])} {number}, {d(1)}", f"Calle del {r.choice(['Horno', 'Sol'])} {number}", f"Avenida de la {r.choice(['Tortuga', 'Luz'])}, {number}, {d(5)} {r.choice(TOWNS)}"])
        if re.search(r"weg|gasse|grund", like):
            return r.choice(["Farnweg", "Kleine Ofengasse", "Amselgrund", "Lindenstraße", "Bahnhofstraße", "Am Markt"]) + f" {number}" + r.choice(["", "a", f", {d(5)} {r.choice(TOWNS)}"])
        street = r.choice(STREETS) if r.random() < 0.75 else r.choice(["Mill", "Church", "Oak", "Station", "Victoria", "Harbour"]) + " " + r.choice(["Road", "Street", "Lane", "Avenue", "Drive", "Close"])
        long, short = r.choice(list(SHORT.items()))
        brief = (street.replace(long, short) if street.endswith(long) else street) + r.choice(["", "."])
        return r.choice([f"{number} {street}", f"{number} {street}", f"{number} {brief}", f"{number}B {street}, Apt {r.randint(1, 60)}, {r.choice(TOWNS)} LK{d(1)} {d(1)}QD", f"Flat {r.randint(1, 20)}, {number} {street}", f"{number} {street}, {r.choice(TOWNS)}", f"{number} {street} {r.choice(TOWNS)} 00{d(3)}", f"{street.upper()} {number}"])

    def make(self, kind: str, like: str) -> str:
        return getattr(self, kind)(like) if kind in ("name", "address") else getattr(self, kind)()

    def none_of(self, kind: str, like: str) -> str | None:
        """What may stand in the place of a mention without being one."""
        r, d = self.r, self.digits
        han = bool(re.search(r"[一-鿿]", like))
        if kind == "name":
            choices = [self.family(), self.given(), f"{self.given()} {r.choice('ABCDEFGHJKLMNOPRST')}.", f"{self.given()} {r.choice('ABCDEFGHJKLMNOPRST')}"]
            if han:
                choices += ["小" + r.choice(GIVEN_ZH), "老" + r.choice(SURNAMES_ZH), "".join(r.choice("檐盐鹭月色赤兔薄音槐薇坊纸雪苔鸥青蓉") for _ in range(4)), "室友", "楼下邻居", "乐队队长", "阿" + r.choice(GIVEN_ZH)]
            return r.choice(choices)
        if kind == "address":
            return r.choice(STREETS_ZH + DISTRICTS_ZH if han else STREETS + TOWNS)
        if kind == "phone":
            return r.choice([f"JT{d(11)}", f"{d(14)}", f"978-{d(1)}-{d(8)}", f"{d(2)}-{d(2)}", f"{d(2)}-{d(2)}-{d(1)}", f"SN-{d(3)}-{d(2)}-A{d(2)}", f"{d(1)}.{d(2)}.{d(1)}", f"20{d(2)}.{d(1)}.{d(2)}"])
        if kind == "id_number":
            return r.choice([f"{d(14)}", f"JT{d(11)}", f"978-{d(1)}-{d(8)}", f"{d(4)}", f"SN-{d(3)}-{d(2)}-A{d(2)}"])
        if kind == "email":
            return r.choice([f"pkg@{d(1)}.{d(2)}.0", "@" + self.given(), f"{d(1)}pm @ home", "https://wiki.example/notes/kiln", self.given().lower() + "_" + self.digits(2)])
        return None


class Wide:
    """Sentences of public form around mentions whose words are put together from syllables."""

    ONSETS = "b br c ch d dr f fl g gr h j k kl l m n p pr r s sch st t tr v w z bj sz zh kh wr qu mb nd thr str sk sh th ph y x cz hr kn mc".split()
    VOWELS = "a e i o u a e i o ai ei ie ou au aa oo é á ö ü y".split()
    GIVEN_ENDS = "a o e in us ia ela ert ine is an y ette ko mi yn iel ida isha esh it ima ul ek el or on ik av ra na ta la nce rd ng gar mar lind uin".split()
    FAMILY_ENDS = (
        "son man berg stein ski ez ini ova sen ton ley ford wood er ard eau ic ak idis oglu strom field well ska czyk enko yan ian sson poulos akis aki moto mura ada awa nathan singh bury ham gate dale thwaite quist lund dahl vik nen tti "
        "illo elli etti zzi eira ales ado nandez croix thal hill land worth thy kwo kwo beki ero anos win feld meyer baum hard rick ault ier el is us"
    ).split()
    STREET_ENDS = "Street St St. Road Rd Rd. Lane Ln Avenue Ave Ave. Drive Dr Court Ct Place Terrace Way Boulevard Blvd Square Crescent Close Hill Row Walk Parkway".split()
    HEAD_STREETS = ["Via", "Viale", "Rue de", "Rue", "Rua", "Calle", "Avenida", "Plaza", "Piazza", "Chemin du", "Boulevard", "Carrer", "Corso", "Place de la", "Paseo del"]
    GLUED_STREETS = "straße strasse str. weg gasse platz allee damm ufer ring straat laan gata gatan vej".split()
    HAN_FAMILY = "王李张刘陈杨赵黄吴徐孙马朱胡郭何高罗郑梁谢唐冯邓曹彭曾田董潘袁蔡蒋余杜戴夏钟汪姜范方石姚谭廖邹熊金郝孔白崔康毛邱江史顾侯邵孟龙万段"
    HAN_GIVEN = "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀霞平刚桂英华建国玉兰红文雪梅宇浩然欣怡子轩梓涵思远嘉琪志鹏晓雨佳慧天佑若曦俊豪诗婷海波永康美玲振东立新"
    HAN_PLACE = "东西南北中山海江河湖新安平和长春秋云龙凤凰金银石松竹梅兰桃李光明红白青翠文武"

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def word(self, ends: list[str], least: int = 1) -> str:
        r = self.r
        body = "".join(r.choice(self.ONSETS) + r.choice(self.VOWELS) for _ in range(r.randint(least, 2)))
        return (body + r.choice(self.ONSETS[:14]) * (r.random() < 0.5) + r.choice(ends)).capitalize()

    def given(self) -> str:
        return self.word(self.GIVEN_ENDS) if self.r.random() < 0.6 else self.r.choice(MORE_GIVEN)

    def family(self) -> str:
        return self.word(self.FAMILY_ENDS) if self.r.random() < 0.7 else self.r.choice(MORE_FAMILY)

    def name(self) -> str:
        r = self.r
        given, family = self.given(), self.family()
        if r.random() < 0.2:
            given += " " + self.given()
        if r.random() < 0.2:
            given += f" {r.choice('ABCDEFGHIJKLMNOPRSTVW')}."
        if r.random() < 0.08:
            given += "-" + self.given()
        if r.random() < 0.12:
            family += r.choice([" ", "-"]) + self.family()
        if r.random() < 0.1:
            family = r.choice(["van ", "von ", "de ", "del ", "van der ", "da ", "O'", "Mc"]) + family
        return r.choice([f"{family}, {given}", f"{given} {family}".upper(), f"{given} {family.upper()}"]) if r.random() < 0.15 else f"{given} {family}"

    def name_han(self) -> str:
        r = self.r
        return r.choice(self.HAN_FAMILY) + "".join(r.choice(self.HAN_GIVEN) for _ in range(r.choice([1, 2, 2])))

    def address(self) -> str:
        r = self.r
        n = f"{r.randint(1, 420)}{r.choice(['', '', '', 'a', 'B', ' bis'])}"
        base = self.word(self.FAMILY_ENDS + ["", "o", "a"]) if r.random() < 0.6 else r.choice("Mill Church Oak Station Park Elm Cedar Roma Main High Victoria Harbour Market Garibaldi Mozart Lincoln King River".split())
        roll = r.random()
        if roll < 0.5:
            street = f"{n} {base}{r.choice(['', '', ' ' + self.word([''])])} {r.choice(self.STREET_ENDS)}"
        elif roll < 0.8:
            street = f"{r.choice(self.HEAD_STREETS)} {base}{r.choice([' ', ', ', ' n° '])}{n}"
            if r.random() < 0.3:
                street = f"{n}{r.choice([' ', ', '])}{r.choice(['rue', 'rue de', 'avenue', 'impasse', 'quai'])} {base}"
        else:
            street = f"{base}{r.choice(self.GLUED_STREETS)} {n}"
        if r.random() < 0.3:
            street += r.choice([f" Apt {r.randint(1, 90)}", f", Apt. {r.randint(1, 90)}", f", Flat {r.randint(1, 90)}", f" #{r.randint(1, 90)}", f", Unit {r.randint(1, 40)}B"])
        if r.random() < 0.3:
            town = self.word(["", "burg", "ville", "ton", "a"]) if r.random() < 0.6 else r.choice(["Turin", "Leeds", "Lyon", "Bern", "Porto", "Graz", "Boston"])
            street += r.choice([f", {town}", f", {r.randint(10000, 99999)} {town}", f", {town} {r.randint(10000, 99999)}"])
        return street

    def address_han(self) -> str:
        r = self.r
        place = lambda n: "".join(r.choice(self.HAN_PLACE) for _ in range(n))
        head = r.choice(["", "", place(2) + "市", place(2) + "市" + place(2) + "区", place(2) + "县"])
        return head + place(r.choice([2, 2, 3])) + r.choice(["路", "街", "巷", "大道", "东路", "里", "弄"]) + f"{r.randint(1, 999)}号" + r.choice(["", f"{r.randint(1, 30)}栋{r.randint(101, 2909)}室", f"{r.randint(1, 9)}单元{r.randint(101, 909)}"])

    def email(self) -> str:
        r = self.r
        user = r.choice([f"{self.given()}.{self.family()}", f"{self.given()}{r.randint(1, 99)}", f"{self.given()[0]}{self.family()}", f"{self.family()}_{self.given()}"]).lower().replace(" ", "")
        host = f"{self.word(['', 'mail', 'net', 'box']).lower()}.{r.choice(['com', 'org', 'net', 'de', 'it', 'fr', 'es', 'io', 'co.uk', 'cn', 'edu'])}"
        return r.choice([f"{user}@{host}"] * 8 + [f"{user} (at) {host.replace('.', ' (dot) ')}", f"{user} at {host.replace('.', ' dot ')}"])

    FRAMES = {
        "name": ["We invited {}", "my boss is {}", "{} wrote to me", "Yesterday {} came by", "I got it from {}, who moved", "ask for {} at the door", "is {} coming?", "with {} and the others", "thanks to {}!", "{} and I went home", "it was {} who rang", "I met {} yesterday", "Call {} now", "my name is {}", "This is {} speaking.", "{} said hello to everyone", "Regards, {}", "please ask {} about the keys", "the landlord is called {}", "we had lunch with {} and talked for hours", "ich heiße {}", "Gestern habe ich {} getroffen.", "je m'appelle {}", "J'ai vu {} hier", "me llamo {}", "hablé con {} ayer", "Dear {}, thank you", "{} lives next door", "tickets for {} are ready", "signed by {} in May", "Did {} ever call back?", "Mr. {} will see you now", "contact: {}", "I think {} moved away. Nobody knows where."],
        "address": ["I live at {}", "send it to {} please", "we moved to {} last week", "{} is the new address", "ich wohne in der {}", "die Adresse ist {}", "j'habite au {}", "vivo en {}", "meet me at {} at noon", "{}", "delivery: {}", "the flat at {} is free", "abito in {}"],
        "email": ["write to {} soon", "my mail: {}", "reach me under {}.", "{} is my address", "schreib an {}", "écris à {}", "mi correo es {}"],
        "name_han": ["我叫{}", "昨天碰到{}了", "{}说他不来", "房东是{}。", "联系人：{}", "请找{}签字", "同事{}辞职了"],
        "address_han": ["我住在{}", "寄到{}，谢谢", "地址：{}", "搬到{}了", "{}"],
    }
    NOUNS = "Common Garden Lanterns Museum Tower Line Market Bridge Station Festival Library Orchestra Café Bakery Theatre Club Harbour Valley Castle Gallery Cup Prize Quartet Hotel Park News Review Award Chapel Observatory Papers Kitchen".split()
    NONE = ["I went to {place} yesterday", "{given} called again", "the {given} you know", "Good Morning {given}", "we took the {place} Line to {place}", "Doctor {family} was late", "Mrs. {family} is our teacher", "the {street} is closed", "turn left into {street}", "we walked along {street} for an hour", "floor 12 of the {place} {noun}", "{place} {noun} is open again", "we met at the {place} {noun}", "they play in the {noun} {noun2}", "{noun2} {noun} is their best song", "he reads {place} {noun} every day", "book {n} of the {lower} saga is finally here", "the {lower} and the {lower} were there", "bus {n} to {place}", "Chapter {n} of The {place} Book", "order {long} was shipped", "version {n}.{n}.{n} is out", "it cost {n} euros in {place}", "room {n}, second floor", "{given} and {given} came along", "The {place} Museum opens at {n}", "my cat {given} sleeps", "Happy Birthday, {given}!", "Saturday Morning in {place}", "小{han}又哭了", "老{fam}来了", "去{hanplace}玩", "走到{hanstreet}就到了", "订单号{long}", "第{n}章写完了"]

    def spliced(self, plain: str) -> tuple[str, list[tuple[int, int, str]]]:
        """A plain segment with a mention between two of its words: a mention is one wherever
        it stands."""
        r = self.r
        places = [i for i, c in enumerate(plain) if c == " "]
        at = r.choice(places) + 1
        kind = r.choices(["name", "address", "email"], [6, 3, 1])[0]
        text = normalised(getattr(self, kind)())[0]
        return plain[:at] + text + r.choice([" ", ", "]) + plain[at:], [(at, at + len(text), kind)]

    def example(self) -> tuple[str, list[tuple[int, int, str]]]:
        r = self.r
        if r.random() < 0.35:
            street = self.word([""]) + " " + r.choice(self.STREET_ENDS).rstrip(".")
            return r.choice(self.NONE).format(
                place=self.word(["", "burg", "ville", "ton", "a"]), given=self.given(), family=self.family(), street=street, noun=r.choice(self.NOUNS), noun2=r.choice(["Paper", "Blue", "Silver", "Old", "Night", "Winter", "Golden", "Little"]), lower=self.word(["", "a"]).lower(), n=r.randint(1, 99), long="".join(r.choice("0123456789") for _ in range(r.randint(9, 16))),
                han=r.choice(self.HAN_GIVEN), fam=r.choice(self.HAN_FAMILY), hanplace="".join(r.choice(self.HAN_PLACE) for _ in range(2)), hanstreet="".join(r.choice(self.HAN_PLACE) for _ in range(2)) + r.choice("路街巷"),
            ), []
        kind = r.choices(["name", "address", "email", "name_han", "address_han"], [5, 4, 1.5, 2, 1.5])[0]
        before, after = r.choice(self.FRAMES[kind]).split("{}")
        if r.random() < 0.25:
            before = r.choice(["By the way, ", "ok so ", "Nobody knew that ", "Well: ", "hm, ", "其实", "对了，"]) + before
        text = getattr(self, kind)()
        span = (len(before), len(before) + len(text), kind.removesuffix("_han"))
        return before + text + after + r.choice(["", "", ".", " :)", ", ok?"]), [span]


def tagged(text: str, found: list[tuple[int, int, str]]) -> tuple[np.ndarray, np.ndarray]:
    tags = np.zeros(len(text), np.int64)
    for a, b, kind in found:
        tags[a:b] = TAGS.index(f"I-{kind}")
        tags[a] = TAGS.index(f"B-{kind}")
    return char_ids(text), tags


def renewed(text: str, found: list[tuple[int, int, str]], maker: Maker, none: float) -> tuple[np.ndarray, np.ndarray]:
    """A copy with new mentions; with probability ``none`` a mention becomes something else."""
    out, spans, at = "", [], 0
    for a, b, kind in found:
        out += text[at:a]
        other = maker.none_of(kind, text[a:b]) if maker.r.random() < none else None
        new = other if other is not None else maker.make(kind, text[a:b])
        if other is None:
            spans.append((len(out), len(out) + len(new), kind))
        out += new
        at = b
    return tagged(out + text[at:], spans)


def examples(texts: list[str], seed: int = 5, limit: int = SAMPLE) -> list[tuple[np.ndarray, np.ndarray]]:
    r = random.Random(seed)
    times = Counter(normalised(s)[0] for t in texts for s in segments(t))
    parts = sorted(p for p in times if p)
    r.shuffle(parts)
    # half of the plain segments are the most frequent ones, the others any
    parts = sorted(parts, key=lambda p: -times[p])[: limit // 2] + parts
    maker = Maker(seed)
    with_, without = {}, {}
    for p in parts:
        found = label(p)
        if len(p) > LONGEST:
            p, found = stretch(p, found, r)
        if found and len(with_) < limit:
            with_[p] = found
        elif not found and len(without) < limit:
            without[p] = p.upper() if r.random() < 0.04 else p
    with_, without = list(with_.items()), list(without.values())
    out = [tagged(p, f) for p, f in with_] + [tagged(p, []) for p in without]
    for p, f in with_:
        out.append(renewed(p, f, maker, 0.25))
    # what is said most often must not be taken for a mention, and is shown more often
    out += 4 * [tagged(p, []) for p in without[:1500]]
    wide = Wide(seed)
    out += [tagged(normalised(t)[0], f) for t, f in (wide.example() for _ in range(MADE))]
    out += [tagged(*wide.spliced(p)) for p in without[:SPLICED] if " " in p and p.isprintable()]
    r.shuffle(out)
    return out


def stretch(text: str, found: list[tuple[int, int, str]], r: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A stretch of a long segment that cuts no mention in two, around one if there is any."""
    a = r.choice(found)[0] - r.randint(0, LONGEST // 2) if found else r.randint(0, len(text) - LONGEST)
    a = max(0, min(a, len(text) - LONGEST))
    b = a + LONGEST
    for x, y, _ in found:
        a = x if x < a < y else a
        b = x if x < b < y else b
    return text[a:b], [(x - a, y - a, k) for x, y, k in found if x >= a and y <= b]


def main(originals: str, episodes: str, start: str | None = None, epochs: str = "4") -> None:
    """Trains from fresh parameters, or goes on from a saved model for a few epochs."""
    from pyspark.sql import functions as F

    from mnemospark.session import session

    spark = session("tagger", "local[4]")
    both = spark.read.parquet(originals).select("content").unionByName(spark.read.parquet(episodes).select("content")).where("content IS NOT NULL").distinct()
    texts = [x[0] for x in both.orderBy(F.xxhash64("content")).limit(TEXTS).collect()]  # a bounded sample
    spark.stop()
    rows = examples(texts)
    held, rows = rows[: len(rows) // 20], rows[len(rows) // 20 :]
    print(len(rows), "examples", flush=True)
    model = Tagger.load(start) if start else Tagger.fresh()
    model.fit(rows, epochs=int(epochs), rate=0.002 if start else 0.004, tell=lambda e, x: print("epoch", e, "loss", round(x, 4), flush=True))
    right = sum(bool((model.viterbi(model.emissions(i[None]))[0] == t).all()) for i, t in held)
    print(f"held-out segments tagged exactly: {right / len(held):.4f} of {len(held)}")
    model.save(Path(__file__).with_name("pii_model.npz"))


if __name__ == "__main__":
    main(*sys.argv[1:5])
