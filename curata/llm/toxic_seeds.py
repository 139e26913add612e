"""Labelled sentences that start the content classifier off: three kinds of abuse, and harmless look-alikes.

Written from general knowledge of such language, by an author who had seen test documents; lines close to theirs were
taken out. Slots in braces are filled with
every word of their list, so that a few lines give the vocabulary of a kind.
"""

from __future__ import annotations

import itertools

# Word lists of the slots.
SLOTS = {
    "insult": "idiot moron imbecile halfwit dumbass loser scumbag bastard parasite pig clown asshole bitch cretin retard coward fool jerk whore slut".split() + ["piece of shit", "piece of garbage", "waste of space", "son of a bitch"],
    "low": "worthless pathetic stupid disgusting useless filthy brainless ugly miserable dumb".split(),
    "group": ["immigrants", "foreigners", "women", "the elderly", "refugees", "muslims", "jews", "gypsies", "those people", "gays", "christians", "blacks", "disabled people"],
    "beast": "vermin filth rats cockroaches animals parasites trash subhuman scum pests".split(),
    "lewd": ["porn", "sex cams", "nude pictures", "xxx movies", "naked girls", "escorts", "hardcore clips", "horny singles", "blowjobs"],
    "zh_insult": "白痴 废物 蠢猪 垃圾 傻逼 脑残 混蛋 笨蛋 贱人".split(),
    "fr_insult": "connard crétin imbécile abruti salaud ordure débile".split(),
    "de_insult": "idiot arschloch vollidiot trottel dreckskerl versager schwein".split(),
    "es_insult": "idiota imbécil estúpido gilipollas basura cabrón inútil".split(),
    "pt_insult": "idiota imbecil burro otário lixo babaca inútil".split(),
    "ru_insult": "идиот дебил урод кретин придурок ничтожество тварь".split(),
}
# The sentences by kind.
SEEDS: dict[str, list[str]] = {
    "abuse": [
        "you {low} {insult}", "shut up you {insult}", "what a {insult} you are", "you are a {low} {insult}", "go and kill yourself", "i hope you die, {insult}", "drop dead", "rot in hell", "fuck you", "fuck off {insult}", "screw you {insult}",
        "i will find you and kill you", "i will beat you up", "i know where you live", "i will break your bones", "i am going to hurt you badly", "you deserve to suffer and die", "someone should shoot you", "get lost {insult}", "nobody likes you, {insult}", "choke on it {insult}", "your mother is a {insult}", "everybody hates you, you {low} {insult}", "you make me sick", "i want to see you dead",
        "你这个{zh_insult}", "滚开，{zh_insult}", "去死吧", "你真是个{zh_insult}", "闭嘴", "我要杀了你", "我要揍你", "你怎么不去死",
        "ferme-la, {fr_insult}", "espèce de {fr_insult}", "tu es un {fr_insult}", "pauvre {fr_insult}", "va te faire foutre", "je vais te tuer", "je vais te casser la gueule", "crève",
        "halt die klappe, du {de_insult}", "du {de_insult}", "du bist ein {de_insult}", "verpiss dich", "fick dich", "ich bringe dich um", "ich schlage dich zusammen", "stirb endlich", "halt die fresse",
        "cállate, {es_insult}", "eres un {es_insult}", "vete a la mierda", "hijo de puta", "te voy a matar", "te voy a romper la cara", "muérete",
        "cala a boca, {pt_insult}", "você é um {pt_insult}", "vai se foder", "seu {pt_insult}", "vou te matar", "vou quebrar a sua cara", "morra",
        "заткнись, {ru_insult}", "ты {ru_insult}", "пошёл вон", "иди к чёрту", "я тебя убью", "я тебе морду разобью", "чтоб ты сдох", "ты тупой {ru_insult}",
    ],
    "hate": [
        "{group} are {beast}", "all {group} are {beast}", "{group} are inferior and stupid by nature", "get rid of all {group}", "{group} should be locked up", "{group} should be exterminated", "hang every one of these {group}", "throw the {group} out, they are {beast}", "we do not want {group} here, they are {beast}", "{group} do not deserve to live", "i despise {group}", "{group} bring nothing but crime and disease",
        "移民都是寄生虫", "把这些外国人都赶出去", "女人都是蠢货", "黑人是低等民族", "这些人都该死", "他们是人类的渣滓", "老人都是累赘",
        "les étrangers sont des parasites, dehors", "les femmes sont inférieures", "les arabes sont des rats", "ces gens sont des animaux", "il faut exterminer cette race", "dehors les immigrés",
        "ausländer raus", "ausländer sind parasiten", "frauen sind minderwertig", "diese leute sind abschaum", "juden sind ratten", "flüchtlinge gehören vergast",
        "fuera los extranjeros", "los inmigrantes son parásitos", "las mujeres son inferiores", "esa gente son animales", "hay que exterminar a los gitanos", "los moros son ratas",
        "fora os imigrantes", "os estrangeiros são parasitas", "as mulheres são inferiores", "essa gente são animais", "é preciso exterminar essa raça", "os ciganos são ratos",
        "мигранты это паразиты", "женщины глупее мужчин по природе", "вон отсюда, чужаки", "эти люди хуже животных", "всех приезжих надо уничтожить", "евреи это крысы",
    ],
    "sexual": [
        "free {lewd} online", "watch {lewd} now", "hot {lewd} in your area", "click here for {lewd}", "she sucked his cock", "he fucked her all night", "he squeezed her naked breasts", "she spread her legs and moaned", "he thrust into her until she came", "they had wild sex", "she had an orgasm", "she took off her panties", "he licked her nipples", "he undressed her and they had sex", "her wet pussy", "his hard dick", "i want to fuck you", "sexy girls strip for you", "masturbating on camera",
        "成人视频免费观看", "黄色电影在线", "他们做爱了一整夜", "她赤裸着身体", "美女脱衣表演", "裸聊", "色情网站", "他抚摸她的乳房",
        "vidéos porno gratuites", "filles nues", "ils ont fait l'amour toute la nuit", "il caressa ses seins nus", "elle gémissait de plaisir sous lui", "sexe en direct",
        "gratis pornos", "nackte frauen", "sie hatten die ganze nacht sex", "er küsste ihre nackten brüste", "sie stöhnte vor lust", "geile weiber",
        "porno gratis", "mujeres desnudas", "tuvieron sexo toda la noche", "le besó los pechos desnudos", "ella gemía de placer", "chicas calientes",
        "pornô grátis", "mulheres nuas", "transaram a noite toda", "ele beijou os seios nus dela", "ela gemia de prazer", "garotas safadas",
        "бесплатное порно", "голые женщины", "они занимались сексом всю ночь", "он целовал её голую грудь", "она стонала от удовольствия", "горячие девушки раздеваются",
    ],
    "": [
        "kill the process with a signal", "the child process died", "a master and slave replica", "abort the job", "brute force attack on the hash", "breast cancer screening data", "the sex of the patient is a column", "sexual reproduction of plants", "the mass of a bass", "strip the white space", "a naked singularity", "shoot the arrow at the target",
        "i hate this exercise", "this is a stupid mistake of mine", "this approach is terrible", "what an ugly formula", "this step is wrong", "i am tired of this problem", "the foreign students were first", "women and men were counted separately", "the old people are 70 years old", "rats were weighed in the laboratory", "moderators delete insults and hate speech",
        "结束进程", "性别是男或女", "这道题太难了", "外国学生先解出来", "tuer le processus", "la colonne sexe", "une erreur stupide de ma part", "les élèves étrangers ont fini", "den prozess töten", "die spalte geschlecht", "ein dummer fehler von mir", "die ausländischen studenten waren schneller",
        "matar el proceso", "la columna sexo", "un error tonto mío", "los estudiantes extranjeros terminaron", "matar o processo", "a coluna sexo", "um erro bobo meu", "os alunos estrangeiros terminaram", "убить процесс", "столбец пол", "глупая ошибка с моей стороны", "иностранные студенты закончили",
    ],
}


def sentences() -> list[tuple[str, str]]:
    """(sentence, kind), slots filled."""
    out = []
    for kind, lines in SEEDS.items():
        for line in lines:
            slots = [k for k in SLOTS if "{" + k + "}" in line]
            for words in itertools.product(*(SLOTS[k] for k in slots)):
                out.append((line.format(**dict(zip(slots, words))), kind))
    return out
