"""Phrases for making defective answers to train on: ways to decline, and markers of a missing answer.

They are combined at random and serve only as training text; no feature of the tagger looks any of them up.
Every ``{}`` takes a word or two of the question.
"""

from __future__ import annotations

# Per language (before the act, acts, whole sentences, openers, closers).
DECLINE = {
    "en": (
        "i can't|i cannot|i could not|i am unable to|i'm not able to|i won't|i will not|i would not|i'd rather not|i would prefer not to|i refuse to|i have to decline to"
        "|we are not allowed to|i am not permitted to|it would not be proper for me to|my rules forbid me to|i was told not to|i have been asked not to|my policy keeps me from trying to|i must not",
        "answer that|answer this one|help with this|help you with that|reply to your question|provide an answer to that request|talk about {}|discuss this matter|discuss {} here|comment on {}"
        "|say anything about {}|give an opinion on {}|respond to this request|get into the {} thing|go into that topic|advise you on this|share views on {}|weigh in on {}",
        "that topic is off limits for me|the subject of {} is off limits|this lies outside what i may talk about|this falls beyond what i can discuss|i have no opinion on {}, i am just a bot"
        "|as a language model i hold no views on {}|i'm only a machine, so i have no opinion on {}|please ask somebody else about that|you should take this question to someone else|you will have to ask elsewhere"
        "|i must pass on this one|i have to pass on that question|no comment from me on {}|there will be no answer from me on {}|i have to decline|this is a thing i must decline|my guidelines keep me from replying|my rules stop me from answering this"
        "|i was asked to leave this subject alone|i have been told to stay away from this topic|it is not my place to comment on your {}|it would not be right for me to speak about {}",
        "|hm, |look, |oh, |sorry, |unfortunately |i'm afraid |thanks for asking but |apologies: |well, |i regret that |pardon me, |hmm, |my apologies, ",
        "|||.|!|. sorry|. hope you understand|, i hope you understand that|. ask me something else|. maybe another subject?|. is there anything else on your mind?| — shall we pick another topic?|. try asking somebody else|, {}.",
    ),
    "fr": (
        "je ne peux pas|je ne dois pas|je ne veux pas|je ne vais pas|je préfère ne pas|je refuse de|je n'ai pas le droit de|on m'a demandé de ne pas|il ne m'est pas permis de|je ne suis pas autorisé à|je ne saurais|j'aime mieux ne pas",
        "répondre à cette question|répondre à cela|parler de ce sujet|commenter cela|aborder ce thème|dire quoi que ce soit sur {}|donner mon avis sur {}|t'aider avec ça|vous aider là-dessus|discuter de {}|rien dire à ce sujet",
        "il faut demander à quelqu'un d'autre|tu devras poser la question à une autre personne|ce sujet m'est interdit|je dois me taire là-dessus|là-dessus je préfère me taire|c'est un sujet dont je n'ai pas le droit de parler|pas de commentaire sur {}|ce n'est pas à moi d'en parler|je m'abstiens de répondre|adresse-toi à quelqu'un d'autre pour {}",
        "|désolé, |pardon, |écoute, |malheureusement, |hélas, |je regrette, |excuse-moi, ",
        "||.|!|, {}.|. désolé|. un autre sujet ?|. j'espère que tu comprends",
    ),
    "de": (
        "darauf kann ich nicht|darauf darf ich nicht|dazu möchte ich nicht|davon will ich nicht|darüber soll ich nicht|ich kann leider nicht|ich darf nicht|ich werde nicht|ich möchte lieber nicht",
        "antworten|eingehen|sprechen|reden|mich äußern|helfen|etwas sagen|diese frage beantworten|über dieses thema sprechen|über {} reden|bei {} weiterhelfen",
        "dazu sage ich lieber nichts|zu diesem thema kann ich nichts sagen|zu dem thema möchte ich mich nicht äußern|das soll jemand anderes beantworten|da musst du jemand anderen fragen|dieses thema ist für mich tabu|mir ist nicht erlaubt, darüber zu sprechen"
        "|man hat mich gebeten, dazu zu schweigen|dabei kann ich dir nicht helfen|von {} soll ich die finger lassen|darüber muss ich schweigen|kein kommentar zu {}|es steht mir nicht zu, das zu kommentieren",
        "|leider, |leider: |tut mir leid, |entschuldige, |hm, |schau, |bedaure, ",
        "||.|!|, {}.|. tut mir leid|. ein anderes thema?|. ich hoffe, du verstehst das",
    ),
    "es": (
        "no puedo|no debo|no quiero|no voy a|no me permiten|no me está permitido|prefiero no|me niego a|no tengo permiso para|no me corresponde|no sería correcto|me han pedido no|mejor no",
        "responder a esa pregunta|responder a eso|hablar de ese tema|hablar sobre {}|comentar este asunto|decir nada sobre eso|opinar sobre {}|ayudarte con eso|contestar a esto|dar mi opinión sobre {}",
        "pregúntale a otra persona|tendrías que preguntar a otro|tendrás que consultar a alguien más|ese tema está prohibido para mí|me han pedido callar sobre eso|de ese asunto no diré nada|de eso no pienso decir nada|sobre {} no puedo opinar|tengo que callarme sobre ese tema|sin comentarios sobre {}",
        "|lo siento, |mira, |perdona, |por desgracia, |lamento decirlo, |ay, |disculpa, ",
        "||.|!|, {}.|. lo siento|. ¿otro tema?|. espero que lo entiendas",
    ),
    "it": (
        "non posso|non devo|non voglio|non mi va di|preferisco non|mi rifiuto di|non ho il permesso di|non mi è permesso|non mi è consentito|non spetta a me|non sono autorizzato a|mi hanno chiesto di non",
        "rispondere a questa domanda|rispondere|parlare di questo argomento|parlare di {}|commentare|commentare questo tema|dire niente su {}|dare un parere su {}|aiutarti con questo|esprimermi in merito",
        "devi chiedere a qualcun altro|dovresti chiedere a un'altra persona|questo argomento mi è vietato|su questo preferisco tacere|di questo non dirò nulla|su {} non ho il permesso di parlare|nessun commento su {}|di ciò devo tacere|non tocca a me parlarne",
        "|mi dispiace, |scusa, |guarda, |purtroppo |ahimè, |senti, ",
        "||.|!|, {}.|. mi dispiace|. un altro argomento?|. spero che tu capisca",
    ),
    "pt": (
        "não posso|não devo|não quero|não vou|prefiro não|recuso-me a|não tenho permissão para|não me é permitido|não me cabe|não estou autorizado a|pediram-me para não|é melhor não",
        "responder a essa pergunta|responder a isso|falar desse assunto|falar sobre {}|comentar|comentar esse tema|dizer nada sobre {}|dar opinião sobre {}|ajudar com isso|opinar sobre isso",
        "terias de perguntar a outra pessoa|pergunta a outra pessoa|tens de consultar outra pessoa|esse assunto é proibido para mim|sobre isso prefiro calar|disso não direi nada|sobre {} não tenho permissão para falar|sem comentários sobre {}|devo calar-me sobre esse tema",
        "|desculpa, |infelizmente, |olha, |lamento, |perdão, |escuta, ",
        "||.|!|, {}.|. desculpa|. outro assunto?|. espero que entendas",
    ),
}

# Markers that stand for a missing answer.
MARKERS = (
    "empty|none|null|nil|nan|n/a|na|blank|missing|undefined|tbd|todo|void|no reply|no answer|no response|no content|no text|no data|without answer|missing answer|empty response|not available|nothing"
    "|sin respuesta|sem resposta|nessuna risposta|sans réponse|pas de réponse|keine antwort"
).split("|")
FRAMES = ("{}", "[{}]", "({})", "<{}>", "{}.", "**{}**", "{{{}}}", "-- {} --", "_{}_")

# Words after which a sentence must go on, by language.
GO_ON = {
    "en": "the a an and or but because my your our their his its with from into than if while although though since until unless which whose every when",
    "fr": "le la les un une des de du et ou mais parce que qui si avec sans pour dans sur chez par mon ma mes ton ta son sa ses notre votre leur au aux à car dont puisque je tu il",
    "de": "der die das den dem des ein eine einen einem einer und oder aber weil dass wenn mit ohne von für bei mein dein sein ihr als ob sowie im am zum zur obwohl damit",
    "es": "el la los las un una de del y o pero porque que con sin para por en mi tu su al si cuando como aunque yo",
    "it": "il lo la i gli le un una uno di del della dei e o ma perché che con senza per in nel nella mio mia al alla se quando da dal io",
    "pt": "o a os as um uma de do da e ou mas porque que com sem para por em no na meu minha ao se quando eu",
}
GO_ON = {k: v.split() for k, v in GO_ON.items()}
# Marks and openers that can end no sentence.
DANGLING = (",", ", and", " (", " “", ":", ", which means", ". first,", ". second of all,", ", because", ' "{}', ', "{}', " (the {}", ": “{}", " (and {}")
