"""Labelled phrases from which the tagger of problem 9 starts.

Fixed values: words of abuse, groups, threats and sexual acts in five languages, and neutral
uses of the same words. They train a classifier that removes such language; the phrases that
are fitted beside them come from the reviewed documents."""

from __future__ import annotations

import itertools

INSULTS = {
    "en": "idiot moron imbecile cretin bastard bitch whore slut pig scum scumbag dumbass asshole degenerate loser clown prick retard trash garbage dickhead cunt fool jerk swine coward shit".split(),
    "de": "Idiot Arschloch Schwein Drecksstück Trottel Wichser Hurensohn Schlampe Miststück Abschaum Versager Vollidiot Penner".split(),
    "fr": "connard salaud enfoiré abruti crétin ordure pute salope imbécile débile bâtard raclure".split(),
    "es": "gilipollas imbécil cabrón idiota puta hijoputa zorra basura cretino payaso bastardo pendejo".split(),
    "zh": "王八蛋 蠢货 垃圾 混蛋 白痴 贱人 废物 狗东西 畜生 傻逼".split(),
}
ADJECTIVES = {
    "en": "stupid fucking pathetic worthless filthy disgusting brainless spineless damn goddamn revolting dirty ugly useless".split(),
    "de": "verdammtes dummes wertloses dreckiges elendes dämliches beschissenes".split(),
    "fr": "sale immonde débile minable stupide pourri".split(),
    "es": "asqueroso inútil repugnante estúpido maldito patético".split(),
    "zh": "该死的 恶心的 下贱的 没用的 愚蠢的 不要脸的".split(),
}
GROUPS = {
    "en": "these migrants|those foreigners|the newcomers|the hill people|people of that faith|women like them|those islanders|the valley folk|these immigrants|that race|those people".split("|"),
    "de": "Die Ausländer|Diese Leute|Die Zugezogenen|Dieses Pack|Diese Weiber".split("|"),
    "fr": "Ces étrangers|Ces gens|Les nouveaux venus|Ces femmes".split("|"),
    "es": "Esos extranjeros|Los recién llegados|Esa gente|Esas mujeres".split("|"),
    "zh": "那些外地人|外来的人|那些山里人|这种人".split("|"),
}
#: {n} an insult, {a} an adjective, {g} a group.
ABUSE = {
    "en": [
        "You are a {a} {n} and everybody knows it", "Shut up, you {a} {n}", "What a {a} {n}, honestly", "That {n} of an editor is a {a} {n}", "Hey {n}, eat dirt and die", "Screw you and your {a} book, you {n}", "Go to hell, you {n}", "The author is a {a} {n} and should be beaten",
        "Only a complete {n} would write that", "Look at this {a} {n}, too dumb to spell and too fat to leave the house", "I hope you choke on it, you {a} {n}", "Crawl back into your hole, {a} {n}", "No one will ever love a {a} {n} like you", "Drop dead, you {n}", "Fuck off, {n}", "you {a} piece of {n}",
        "Go and kill yourself, nobody would miss you", "I know where you live and I will break your bones", "Watch your back, because I am going to find you and hurt you", "I will wait outside your door and you will bleed", "I am going to burn your house down", "You should have been drowned at birth, you ugly waste of air", "do us a favour and disappear for good", "someone ought to shoot you in the head",
        "{g} are vermin and should be driven into the sea", "{g} are filth, not human beings", "Get rid of {g} once and for all", "{g} do not deserve rights and should hang", "Nobody should hire {g}, because their kind is subhuman and stinks", "The only good ones among {g} are the dead ones", "{g} are too stupid to be taught anything", "What did I expect from {g}, born liars with dirty blood", "{g} breed like rats and somebody should sterilise them", "{g} are all thieves and animals and should never have been allowed in", "If {g} come here, bring knives", "One more word from {g} and we burn their houses down", "whoever defends {g} is a {a} traitor who should hang",
        "He fucked her against the wall until they both came", "She was naked on her knees, sucking his cock while he moaned", "He spread her legs and thrust into her until she screamed with pleasure", "Send me pictures of your tits, you dirty slut", "I want to lick you all over and feel you come inside me", "They rubbed their naked bodies together, his hard cock between her wet thighs", "he slid his fingers into her wet pussy",
    ],
    "de": [
        "Was für ein {a} {n}", "Du {a} {n}, halt die Fresse", "Halt dein Maul, du {n}", "Du bist ein {a} {n} und alle hassen dich", "Verpiss dich, {n}", "Geh doch sterben, dich vermisst keiner", "Ich finde dich und schlage dich tot", "Ich weiß, wo du wohnst, und breche dir die Beine", "Ich steche dich ab",
        "{g} sind Abschaum, man sollte sie alle ertränken", "{g} ist Ungeziefer und gehört vernichtet", "{g} sind dreckige Tiere und gehören vergast", "Er fickte sie nackt auf dem Tisch, bis sie laut stöhnte", "Sie nahm seinen steifen Schwanz in den Mund", "Er drang tief in ihre nasse Muschi ein",
    ],
    "fr": [
        "Tu n’es qu’un {n} {a} et tout le monde te déteste", "Ferme ta gueule, espèce de {n} {a}", "Va crever, {n} {a}", "Va te faire foutre, {n}", "Quel {n} de merde a traduit ça", "Je sais où tu habites et je vais te casser la gueule", "Je vais te retrouver et te tuer", "Va mourir, personne ne te regrettera",
        "{g} sont de la vermine, il faut les exterminer", "{g} sont des sous-hommes qui puent", "{g} sont des animaux, qu’on les noie", "Il la baisait contre le mur et elle criait de plaisir", "Nue, elle le suçait pendant qu’il gémissait", "Elle prit sa bite dans sa bouche",
    ],
    "es": [
        "Eres un {n} {a} y ojalá te mueras", "Cállate, {n} {a}, hijo de puta", "Cállate, {n} de mierda", "Vete a la mierda, {n}", "¿Quién tradujo esto, algún {n} {a}", "Sé dónde vives y te voy a romper la cara", "Voy a encontrarte y matarte", "Mátate, nadie te va a extrañar",
        "{g} son escoria, ni siquiera son personas", "{g} son una plaga, hay que exterminarlos", "{g} son animales sucios", "Desnuda, se la chupaba mientras él gemía", "La follaba contra la pared y ella gritaba de placer", "Le metió la polla en la boca",
    ],
    "zh": [
        "你这个{a}{n}，滚出去去死吧", "他妈的，这个{a}{n}就是一坨狗屎", "翻译的人真是{a}{n}", "闭嘴，{n}", "操你妈，{a}{n}", "我知道你住在哪里，我要打断你的腿", "我要杀了你全家", "去死吧，没人会想你",
        "{g}都是害虫，应该全部消灭", "{g}都是下等的畜生，不配活着", "把{g}都赶进海里淹死", "他把她按在床上，粗暴地插入她的身体", "她赤裸着身体跪在他面前为他口交，他大声呻吟", "两人赤裸着交缠，高潮连连",
    ],
}
NEUTRAL = [
    "The cock crowed twice before dawn", "An ass and two mules pulled the wagon", "The breeder kept one bitch and four pups of that litter", "The rats were treated as vermin by the board and traps were laid", "The process was killed after the child thread stopped responding", "The master clock drives each slave clock", "A breast tumour was removed without complication",
    "The patient reported pain during intercourse", "Sex determination in this beetle depends on temperature", "The nude study hangs above the door", "The naked eye cannot resolve the second star", "The committee discussed how hate speech and threats should be reported and removed", "She confessed that she felt stupid for losing the key", "The reviewer wrote that the plot was a total disaster and the style awful",
    "I hate the new cover, but the text is a killer", "He had shot the scene twice before noon", "Execution of the contract was suspended and the deadline is dead", "The villain cursed loudly and left", "Penal law of the province is described in section four", "Racial slurs are defined in the appendix", "The term idiot was once a medical category", "The pigs were kept in a dirty shed", "The word bitch denotes a female dog", "Screw the plate to the wall and pin the sheet",
    "The chapter is boring, badly written and far too long", "The vaginal swab and the penis were examined by the doctor", "The migrants arrived in spring and the newcomers found work", "The islanders and the valley folk trade in wool", "Women like them founded the first school", "People of that faith celebrate in autumn", "The foreigners were welcomed by the mayor", "The lion will kill its prey and bleed it", "The dead were buried in the garden", "The clown made the children laugh", "The garbage is collected on Monday", "trash and filth were cleared from the river",
    "Die Hündin warf vier Welpen", "Die Ratten gelten hier als Ungeziefer", "Der hängende Prozess wurde getötet und neu gestartet", "Das Geschlecht der Käfer hängt von der Temperatur ab", "Die Rezension nannte den Stil schlicht furchtbar", "Die Ausländer fanden Arbeit im Hafen", "Das Schwein lag im Stall", "Der Schwanz des Hundes ist lang", "Er war nackt, als der Arzt kam",
    "La chienne a mis bas quatre chiots", "Les rats sont traités comme de la vermine par le port", "Le processus bloqué a été tué puis relancé", "Le sexe de ces insectes dépend de la température", "La critique jugea le style tout simplement affreux", "Les nouveaux venus ouvrirent une école", "Les ordures sont ramassées le lundi",
    "La perra tuvo cuatro cachorros", "La langosta es una plaga en estos campos", "El proceso bloqueado fue eliminado y reiniciado", "El sexo de estos insectos depende de la temperatura", "La reseña decía que el estilo era horrible", "Los recién llegados abrieron una escuela", "La basura se recoge el lunes", "El payaso hizo reír a los niños",
    "母狗生了四只小狗", "蝗虫是这一带的害虫", "卡住的进程被杀死后重新启动", "这种昆虫的性别取决于温度", "书评说这本书的文笔糟透了", "垃圾每周一清运", "外来的人在港口找到了工作", "那些山里人种茶为生", "家里养了几头牲畜",
]

NEUTRAL_OF_GROUPS = {
    "en": ["The customs of {g} are described in the chapter", "The songs of {g} were collected in spring", "A school for {g} was opened by the council", "{g} trade in wool and salt", "The book tells how {g} crossed the river", "The law of {g} is printed in section two"],
    "de": ["{g} feiern im Herbst", "Im Kapitel über die Stadt heißt es, {g} fanden Arbeit"],
    "fr": ["{g} vendent de la laine au marché", "Le chapitre décrit comment {g} arrivèrent au port"],
    "es": ["{g} celebran en otoño", "El capítulo cuenta cómo {g} llegaron al puerto"],
    "zh": ["{g}在春天种茶", "书里写道，{g}住在河边"],
}


def phrases() -> list[tuple[str, int]]:
    """(phrase, 1 abusive or 0 neutral), every word of each list used in some phrase."""
    out = [(x, 0) for x in NEUTRAL for _ in range(3)]
    out += [(form.replace("{g}", g), 0) for lang, forms in NEUTRAL_OF_GROUPS.items() for form in forms for g in GROUPS[lang]]
    for lang, forms in ABUSE.items():
        nouns, adjectives, groups = itertools.cycle(INSULTS[lang]), itertools.cycle(ADJECTIVES[lang]), itertools.cycle(GROUPS[lang])
        for form in forms:
            for _ in range(len(INSULTS[lang]) if "{n}" in form else len(GROUPS[lang]) if "{g}" in form else 3):
                text = form
                while "{n}" in text:
                    text = text.replace("{n}", next(nouns), 1)
                text = text.replace("{a}", next(adjectives)).replace("{g}", next(groups))
                out.append((text[0].upper() + text[1:], 1))
            next(nouns)
    return out
