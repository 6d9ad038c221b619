"""A bounded sample of labelled sentences, made by rule, from which ``memloom.llm.pii`` fits its weights.

No labelled rows exist, so sentences are composed here: frames in four languages, filled with personal names (slots in capitals) and
with other capitalised words (places, projects, organisations, days, nouns). SAMPLE bounds it. Tests use frames and names of
their own, none of which is in this module.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

#: Sentences in the sample (parameter of ``sentences``).
SAMPLE = 12000

#: Common given and family names.
GIVEN = "Al Bo Cy Di Ed Jan Kim Lee Meg Amy Ian Eva Ada Anna Maria Laura Julia Sarah Emma Olivia Sophie Clara Lena Hannah Katrin Sabine Petra Ines Carmen Lucia Elena Pilar Rosa Marta Nadia Aisha Fatima Priya Mei Yuki Grace Ruth Alice Helen James John Robert Michael David Thomas Daniel Peter Paul Mark Andrew Stefan Klaus Jürgen Uwe Markus Felix Lukas Jonas Carlos Javier Miguel Pablo Diego Andrés Luis Omar Ahmed Ravi Arjun Kenji Ivan Marco Luca Tom Ben Sam Max Leo Jack Harry".split()
FAMILY = "Smith Jones Brown Taylor Wilson Evans Walker Wright Turner Parker Cooper Bennett Hughes Murphy Kelly Müller Schmidt Schneider Fischer Weber Wagner Becker Hoffmann Schäfer Koch Richter Wolf Krüger García Martínez López Sánchez Pérez Gómez Fernández Díaz Torres Ruiz Navarro Ortega Singh Patel Khan Chen Wang Tanaka Rossi Novak Larsen Jensen O'Neil McKay".split()
ZH_FAMILY = list("王李张刘陈杨黄赵吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶") + ["欧阳", "司马", "诸葛", "上官"]
ZH_GIVEN = list("伟芳娜敏静强磊军洋勇艳杰娟涛超明霞平刚鹏华飞玉红") + ["小明", "建国", "志强", "晓东", "丽华", "雨桐", "子涵", "思远", "文博", "海燕"]

_PART = ("bar cal den el fen gar hol ir jor kel lam mor nor or pel quin ros sel tor ul ver wex yar zan", "a e i o u an en in on ar er or", "bert dale ford gan leth mond nick quist rane rick sby stad ton vane well wick wyn zar mere ley")

#: Frames with names. N full or given name, G given name, F family name, T title.
NAMED = (
    "I met N yesterday near the market", "we ran into N at the station", "my colleague N will send the figures", "my friend N has the spare keys", "our neighbour N watered the plants", "N and N joined the review", "N, N and N were late again",
    "please forward this to N before Friday", "can you tell N about the change?", "give it to N when you see them", "dinner with N on Saturday", "N will join us for lunch", "N is on holiday until Monday", "N was not at the office today", "N wrote that the report is done",
    "N said it would rain", "N told me about the new lease", "N rang twice this morning", "the parcel is for N", "T F has signed the form", "ask T F for the key", "T F, could you look at this?", "Dear N,\nthank you for the cake", "Hi G,\nsee you soon", "Thanks, G", "Thanks, G", "thank you, G, see you", "Cheers, G", "bye G", "Danke, G", "Gracias, G", "Hello G, how are you?",
    "Best wishes,\nN", "Kind regards,\nN", "Cheers,\nG", "written by N", "a note from N about the boat", "N's bicycle is in the yard", "I borrowed N's ladder", "G's mother called", "it was N who found the keys", "her brother G plays the viola", "his wife G works there", "the doctor is called N", "my name is N", "I'm N, nice to meet you", "this is N speaking",
    "call N on the new number", "I spoke with N about it", "N asked whether we could wait", "signed, N", "signature from N is missing", "return to N, thanks", "we stayed with N and N over the summer", "N moved the appointment", "T F moved the appointment", "invited: N, N, N", "contact: N", "Attendees: N and N", "assigned to N", "N (accounting) replied",
    "ayer vi a N en la plaza", "mi amiga N tiene las llaves", "mi jefe N llega tarde", "N y N vinieron a la reunión", "N dijo que no", "N llamó por la mañana", "pregunta a N por la mesa", "cena con N el sábado", "dale esto a N, por favor", "T F ha firmado", "Querida G:\ngracias por todo", "Hola G, ¿qué tal?", "Saludos,\nN", "un mensaje de parte de N", "me llamo N", "soy N, encantada", "el coche de N está roto", "N no vino ayer", "N va a escribir mañana", "hablé con N sobre el viaje", "N pregunta si hay sitio", "la hermana de G canta",
    "gestern habe ich N getroffen", "mein Chef N kommt später", "meine Kollegin N schickt den Bericht", "N und N waren auch da", "N hat angerufen", "N sagte, es wird kalt", "N schreibt morgen", "bitte gib das N", "frag N nach dem Schlüssel", "Abendessen mit N am Samstag", "T F hat unterschrieben", "Liebe G,\ndanke für alles", "Hallo G, wie geht's?", "Viele Grüße\nN", "ich heiße N", "ich bin N, freut mich", "das Fahrrad von N ist weg", "N ist krank", "N fragt, ob es passt", "wir wohnten bei N und N", "Unterschrift von N fehlt",
)
#: What people do (after a name), what is done to them (before one), and what they are to each other; en, es, de.
ACTS = {
    "e": "said says told wrote asked called rang came went left arrived stayed forgot remembers booked paid bought sold lost found signed sent brought baked cooked ate likes loves hates wants needs thinks knows believes hopes lives works plays sings paints reads smiled laughed cried married moved waited helped taught agreed refused complained apologised promised passed dropped picked fed watered repaired borrowed invited visited met saw heard got took gave has had will would can could should might and or".split(),
    "s": "dijo dice olvidó reservó compró vendió vino llegó salió trajo llevó cree sabe quiere vive trabaja canta toca pinta perdió encontró firmó envió escribió ayudó esperó llamó cocinó prometió se ha va tiene puede y riega cuida".split(),
    "d": "sagte sagt vergaß vergisst bucht backt kocht zieht ziehen kam kommt ging geht brachte bringt glaubt weiß will wohnt arbeitet singt spielt malt verlor fand hilft wartet hat ist wird kann soll mag lacht fragt schrieb schreibt rief und gießt".split(),
}
DOINGS = {
    "e": "surprise invite thank pay owe ask tell remind congratulate call visit meet met saw see help helped hear heard from with by for to about that and did does has would could will should let from with by".split(),
    "s": "a con de para por que y sin invita_a felicita_a avisa_a pregunta_a vi_a conozco_a cené_con según".split(),
    "d": "mit von für dass und ohne frag ruf besuche triff kennst_du kannst_du hat sah traf bei".split(),
}
KIN = {
    "e": "aunt uncle cousin neighbour boss teacher friend sister brother daughter son colleague landlord dentist nurse manager".split(),
    "s": "tía tío prima vecina vecino jefa jefe profesora amiga amigo hermana hermano hija hijo compañera".split(),
    "d": "Tante Onkel Cousine Nachbarin Nachbar Chefin Lehrerin Freundin Freund Schwester Bruder Tochter Sohn Kollegin".split(),
}
#: Frames of these: <v> an act, <b> a doing, <k> a relation.
BY_ACTS = {
    "e": ("N <v> the boat", "N <v> again", "N <v> it yesterday", "Yesterday N <v> two boxes", "I think N <v> too", "we <b> N on Sunday", "please <b> N soon", "<b> N", "they <b> N, I guess", "it is <b> N", "my <k> N <v> soup", "her <k> N is here", "the <k> is N", "N and N <v> early", "Has anyone <b> N lately?", "Would N <v> this?"),
    "s": ("N <v> la sopa", "N <v> ya", "ayer N <v> dos cajas", "creo que N <v> tarde", "fuimos <b> N", "es <b> N", "mi <k> N <v> bien", "la <k> N está aquí", "N y N <v> pronto"),
    "d": ("N <v> die Suppe", "N <v> schon", "gestern <v> N zwei Kisten", "ich glaube, N <v> spät", "wir <b> N", "das ist <b> N", "meine <k> N <v> Brot", "der <k> N ist da", "N und N <v> bald"),
}
#: Frames whose capitalised words are no persons. P place, Q project, O organisation, D day or month, W German noun.
OTHERS = (
    "we moved to P last year", "the train to P was late", "they live in P now", "it rained in P all D", "a walk from P to P takes an hour", "the office in P is closed", "near P there is a lake", "P is lovely in spring", "the P bridge was shut", "at the P market we found it", "see you at P Station", "the road through P is dry", "he grew up outside P",
    "we moved the talk to P, as it rained", "they sent it to P, but it came back", "he went to P, then home", "3 Hill Street, Apt 1, P", "P, second floor", "P 30551 and ring twice", "the letters mention P twice", "both notes name P", "the visit was moved to P", "we moved the talk to P because of the rain", "they shipped it to P last week", "a map of P", "P lies by the sea", "between P and P it snows", "it was found in P", "back from P", "P or P, who cares", "12 Mill Road, P", "Flat 3, P 20114", "Apt 9, P 51002", "2nd floor, P", "Tel. 555", "Fax 20", "Room Five", "Sundays are slow", "Every week P is full", "only P gives a date",
    "for Q we compared the answers", "the Q plan was dropped", "Q starts on D", "notes of Q", "the meeting about Q was long", "in Q everyone agreed", "Q needs another review", "Q was exported twice", "members of Q wait", "Q needs two more days", "Q needs another walk", "Q is behind schedule", "Q has new goals", "Q will end soon", "5 Mill Lane, P and ring", "7 Gate Street, P 20113 and knock", "Rent for the flat rose", "Access for guests is closed", "Scores for the quiz fell", "minutes of Q were lost", "the Q team met", "Q closed with nine answers",
    "O sent a letter", "a letter from O arrived", "O has raised the price", "she works at O", "the O invoice is wrong", "I bought it from O", "O support replied",
    "on D we bake", "Every D there is soup", "The lamp is broken", "Nobody objected to it", "Someone asked for the bowl", "An imported record has no time", "Later they left", "When the lease ends, we move", "If it rains, stay", "Recall fell by half", "Version two is out", "Noted: the plan changed", "We walked home", "They want to sing", "It took an hour", "Did you see it?", "Please keep the lamp", "Thanks for the cake", "Regards to all", "English is fine", "The Spanish class is full", "Hello everyone", "Good morning all", "Happy Birthday", "Reminder: bring water", "Agent: noted", "Owner: yes", "TODO: call back", "PDF attached", "The USB cable is lost", "Call the office", "Ask the agent", "Tell them soon", "Meet me there", "Tea with Milk", "Status: Done", "Total: Twelve",
    "fuimos a P en tren", "vive en P desde D", "el plan de Q fue archivado", "para Q se compararon respuestas", "Q necesita otro día", "Q necesita otra semana antes de cerrar", "Q está parado", "Q va lento", "Q tiene dos meses de retraso", "las notas de Q", "la oficina de P cierra", "Quieren cantar en P", "El contacto llevará sopa", "La persona dijo que no", "Una marca fue archivada", "Nadie se opuso", "Según O no hay plazas", "Cuando llueve, no salen", "Gracias por la sopa", "Alguien preguntó por la mesa", "O mandó una carta", "En P llovió", "De P a P hay un tren", "Antes le gustaba leer", "Después se fueron", "movimos el curso a P, porque llovió", "calle 4, 20114 P, tel. 555", "de P a P se tarda una hora", "movimos la cena a P", "dos notas mencionan P", "P está lejos", "cerca de P hay un lago",
    "sie wohnen in P", "der Zug nach P war spät", "für Q wurden Antworten verglichen", "der Plan von Q wurde verworfen", "Q braucht noch eine W", "Q braucht mehr W", "Q steht still", "Q geht weiter", "Q hat zwei Wochen Verzug", "Q wird verschoben", "laut Q fehlt W", "der W ist in der W", "die W und die W sind weg", "das W kostet viel", "ein W aus W", "ohne W keine W", "mit dem W zur W", "Der W bringt den W", "Die W hat keinen W", "Niemand mag W", "W und W fehlen", "Heute gibt es W", "im W steht eine W", "O schickt eine W", "Bitte den W mitbringen", "Wenn der W fehlt, geht die W nicht", "W für die W", "Sie wollen W reparieren", "Laut W ist die W alt", "Jeder W zählt", "Danke für die W", "Alle W sind neu", "gegen W hilft W", "am nächsten W", "gestern W regnete es", "heute W fehlt er", "Weg 4, 20114 P, Tel. 555", "verlegt nach P, weil es regnete", "vor zwei W", "seit drei W", "lieber W als W", "zwei W später", "von P nach P", "wir verlegten das W nach P", "in P regnet es", "zwei Briefe nennen P", "P liegt am See", "ein paar W aus P", "W am D", "über den W sprechen",
)
#: Chinese frames with names (N), and without.
ZH_NAMED = (
    "N明天来开会", "N说不用了", "N今天没来", "昨天碰到N，聊了很久", "请把文件交给N。", "跟N一起吃饭", "N和N都来了", "我是N，你好", "我叫N。", "同事N去出差了", "找N签字", "问问N吧", "N的车坏了", "N打来电话", "联系N，谢谢", "N老师请假了", "N医生建议休息", "和N约好了", "谢谢N！", "N在家", "N会带蛋糕", "N已经走了", "收件人：N", "N告诉我改期了", "N问能不能换时间", "住在N家", "邻居N很热心", "让N来处理", "今天N请假了", "上午N来过", "昨晚N没睡好", "早上N在门口等", "刚N还在", "明天N休息", "转给N", "请N过来", "和N同去",
)
ZH_OTHERS = ("谢谢", "好的，谢谢", "谢谢！", "白石镇在哪里", "高桥广场见", "去黄河边", "在白沙镇", "高兴见到大家", "黄色的灯坏了", "白天很热", "石头很重", "马上就到", "方案已经定了", "周末去爬山", "钱包丢了", "江边散步", "金属外壳坏了", "于是大家走了", "何时出发", "林子里有鸟", "温度太高", "高处风大", "万一下雨呢", "成绩出来了", "常常迟到", "任务完成", "程序出错", "许多人来了", "陈旧的记录", "张贴通知", "包裹到了", "花开了", "梁上有灯", "田里有水", "叶子黄了", "汤很好喝", "段落太长")
#: Chinese words that begin with a family name, and what stands before and after such words in running text.
ZH_WORDS = ("谢谢", "谢意", "高山", "黄油", "白菜", "石桥", "马车", "方向", "周刊", "钱币", "江水", "金鱼", "林地", "温泉", "成果", "常识", "任意", "程度", "许可", "陈列", "张力", "包子", "花园", "梁柱", "田地", "叶片", "汤勺", "段子", "罗盘", "毛笔", "姜片", "李子", "唐装", "夏天", "秋千", "史书", "顾客", "孟春", "龙虾", "文件", "武术", "易拉罐", "乔木", "贺卡", "余额", "潘多拉", "杜鹃", "戴上", "钟头", "汪洋", "范围", "谭子", "邹城", "陆地", "孔雀", "康复", "邱陵")
ZH_BEFORE = ("买了", "这些", "一个", "看见那只", "关于", "喝了", "旧", "两周前的", "拿着", "新", "三", "种", "把大", "放好", "最近的", "行", "用", "很多", "那年", "送来")
ZH_AFTER = ("的事", "不见了", "。", "，很好", "在哪里", "和茶", "放在桌上", "已经旧了", "都卖完了", "很多", "要修", "也不错", "来自山里")
NOUNS = "Lampe Schale Suppe Brücke Rechnung Vermieter Kontakt Rundbrief Bericht Schlüssel Fenster Garten Bahnhof Termin Kuchen Walnuss Koffer Leiter Heizung Gruppe Antwort Frist Miete Pumpe Decke Kamera Tasche Zeitung Woche Monat Jahr Arzt Verein Markt".split()
DAYS = "Monday Tuesday Friday Sunday January March July October lunes viernes Montag Freitag Samstag Januar".split()
FIRMS = "Northwind Globex Initech Umbrella Contoso Postbank Telekom Stadtwerke Iberia Correos Lufthansa Acme Siemens Bosch".split()
ADJECTIVES = "Quiet Velvet Copper Glass Silver Hollow Bright Broken Distant Golden Narrow Iron Blue Red Green Wooden Early Late Long Cold Warm Old Young High Deep North South East West Stone".split()
THINGS = "Lantern Anchor Meadow Bridge Garden River Tower Engine Bell Mirror Wagon Candle Forest Needle Window Table Road Rain Moon Sun Door Wheel Clock Field Hill Lake Cloud Spring Winter Stone Horse Fox".split()
TITLES = ("Dr.", "Mr.", "Mrs.", "Ms.", "Prof.", "Herr", "Frau", "Señora", "Doctor")


def _made(r: random.Random) -> str:
    a, b, c = (x.split() for x in _PART)
    return (r.choice(a) + (r.choice(b) if r.random() < 0.4 else "") + r.choice(c)).capitalize()


def _name(r: random.Random, slot: str) -> str:
    given = r.choice(GIVEN) if r.random() < 0.6 else _made(r)
    family = r.choice(FAMILY) if r.random() < 0.5 else _made(r)
    if slot == "G":
        return given
    if slot == "F":
        return family
    kind = r.random()
    return given if kind < 0.35 else f"{given} {family}" if kind < 0.9 else f"{given} {r.choice('ABCDEJKLMR')}. {family}" if kind < 0.95 else f"{given} {family}-{r.choice(FAMILY)}"


def _other(r: random.Random, slot: str) -> str:
    if slot == "Q":
        # A project's name is of two words of the language; of any two, so that no pair is known by itself.
        return " ".join(w.capitalize() for w in (r.choice(ADJECTIVES) if r.random() < 0.7 else _made(r), r.choice(THINGS) if r.random() < 0.7 else _made(r)))
    return {"P": _made(r), "O": r.choice(FIRMS), "D": r.choice(DAYS), "W": r.choice(NOUNS)}[slot]


def _fill(r: random.Random, frame: str) -> tuple[str, list[tuple[int, int]]]:
    """A frame with its slots filled, and where the names stand."""
    out, names = "", []
    for i, c in enumerate(frame):
        alone = not (frame[i - 1 : i].isalnum() and frame[i - 1 : i].isascii() or frame[i + 1 : i + 2].isalnum() and frame[i + 1 : i + 2].isascii())
        if c in "NGF" and alone:
            x = _name(r, c)
            names.append((len(out), len(out) + len(x)))
        else:
            x = r.choice(TITLES) if c == "T" and alone else _other(r, c) if c in "PQODW" and alone else c
        out += x
    if not names and out[0].islower() and r.random() < 0.5:
        out = out[0].upper() + out[1:]
    return out, names


def _acting(r: random.Random) -> str:
    lang = r.choice("eeesd")
    frame = r.choice(BY_ACTS[lang])
    for tag, words in (("<v>", ACTS), ("<b>", DOINGS), ("<k>", KIN)):
        frame = frame.replace(tag, r.choice(words[lang]).replace("_", " "))
    return frame


def _again(r: random.Random, text: str, names: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """The same name once more, far from any cue, now and then in a slightly different spelling."""
    word = text[slice(*names[-1])].split(" ")[-1]
    if len(word) > 4 and r.random() < 0.4:
        at = r.randrange(2, len(word) - 1)
        word = r.choice([word[:at] + word[at + 1 :], word + "s", word[:at] + r.choice("aeiouy") + word[at + 1 :]])
    frame = r.choice(["{} was there too", "Maybe {}", "{} again", "Without {} it is dull", "Sin {} no", "Ohne {} geht es nicht", "Only {} knows"])
    at = len(text) + 2 + frame.index("{")
    return f"{text}. {frame.format(word)}", [*names, (at, at + len(word))]


def sentences(count: int = SAMPLE, seed: int = 11) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """(text, places of names), ``count`` of them, the same for the same seed."""
    r = random.Random(seed)
    for _ in range(count):
        kind = r.random()
        if kind < 0.08:
            frame = r.choice(ZH_NAMED)
            text, names = "", []
            for c in frame:
                x = r.choice(ZH_FAMILY) + r.choice(ZH_GIVEN) if c == "N" else c
                if c == "N":
                    names.append((len(text), len(text) + len(x)))
                text += x
        elif kind < 0.2:
            word = lambda: r.choice(ZH_WORDS)
            text, names = r.choice((lambda: r.choice(ZH_OTHERS), lambda: r.choice(ZH_BEFORE) + word() + r.choice(ZH_AFTER), lambda: r.choice(ZH_BEFORE) + word() + r.choice(ZH_AFTER), lambda: f"{word()}和{word()}{r.choice(ZH_AFTER)}", lambda: word() + r.choice(ZH_AFTER)))(), []
        else:
            text, names = _fill(r, r.choice(NAMED) if kind < 0.32 else _acting(r) if kind < 0.5 else r.choice(OTHERS))
            if r.random() < 0.3:
                other, more = _fill(r, r.choice(NAMED + OTHERS * 2))
                names = names + [(a + len(text) + 2, b + len(text) + 2) for a, b in more]
                text = f"{text}. {other}"
            if names and r.random() < 0.25:
                text, names = _again(r, text, names)
        yield text + r.choice(["", ".", "!"]), names
