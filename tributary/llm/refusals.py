"""A classifier of sentences: declining to answer, courtesy around it, or a statement.

A softmax regression over words, word pairs and marks, fitted on the labelled sentences below and on the sentences of
a bounded sample of reference answers (``REFERENCE_ROWS`` rows, by a threshold on the hash of the text), which are
statements. Names and numbers count as classes: whether they stand in the question, or are new.
"""

from __future__ import annotations

import re

import numpy as np

REFERENCE_ROWS = 500
KINDS = ("decline", "courtesy", "statement")

# Labelled sentences of this project: "?" stands for a name of the question, "#" for a name that the question lacks.
DECLINES = """
I cannot answer that. | I can't help with that. | I cannot answer this question. | I am not able to answer this question. | I'm unable to provide an answer. | I am unable to assist with this request.
I won't be able to assist here. | I will not answer this. | I must refrain from answering. | I have to decline this request. | I must decline. | I decline to answer. | I would rather not say. | I'd prefer not to answer this.
It would not be appropriate for me to respond. | This is not something I can discuss. | Answering this lies outside what I can do. | That is beyond what I can help with. | As a language model, I cannot answer that. | As an AI, I'm unable to help with this.
I'm sorry, but I cannot answer that. | Sorry, I can't help with that. | Unfortunately, I am not able to answer this question. | I apologise, but I have to decline this request. | My apologies: I must refrain from answering. | I'm sorry, but this is not something I can discuss.
I cannot answer that without more context. | I'm unable to provide an answer based on what I was given. | I have to decline this request at this time. | I can't help with that, as it may involve internal code. | I am not able to answer this question; please consult the owner of the repository.
As a language model, it would not be appropriate for me to respond. | Unfortunately, answering this lies outside what I can do. | I am not going to answer this question about ?. | Sorry, this falls outside my remit. | I can't comment on ?. | I refuse to answer. | I'm not allowed to answer questions about ?. | I am not comfortable answering this. | I won't discuss ? here.
I do not have permission to share this. | Sorry, I cannot say anything about ?. | I'm afraid I can't do that. | I'm not in a position to answer. | I cannot provide this information. | I can not assist you with this question. | This request cannot be answered by me.
Es tut mir leid, das kann ich nicht beantworten. | Das kann ich leider nicht beantworten. | Leider kann ich dabei nicht helfen. | Dazu kann ich keine Auskunft geben. | Dazu möchte ich nichts sagen. | Ich kann diese Frage nicht beantworten. | Ich darf dazu keine Auskunft geben. | Bei dieser Frage kann ich nicht weiterhelfen. | Darauf möchte ich nicht antworten. | Ich bin nicht in der Lage, diese Frage zu beantworten. | Tut mir leid, darauf kann ich keine Antwort geben. | Ich muss die Antwort ablehnen.
Je suis désolé, je ne peux pas répondre. | Désolé, je ne peux pas vous aider. | Je préfère ne pas répondre à cette demande. | Il ne m'est pas possible de répondre à cette question. | Je ne suis pas en mesure de répondre. | Je ne peux pas répondre à cette question. | Je ne suis pas autorisé à en parler. | Malheureusement, je ne peux pas vous aider avec cela. | Je dois refuser cette demande.
Lo siento, no puedo ayudar con eso. | No puedo responder a esta pregunta. | No me es posible responder a esta pregunta. | Prefiero no contestar a esa petición. | No estoy autorizado a responder. | No estoy en condiciones de responder. | Lamentablemente no puedo contestar. | Debo rechazar esta petición.
Mi dispiace, non posso rispondere a questa domanda. | Non posso aiutarti con questo. | Preferisco non rispondere. | Non sono in grado di rispondere. | Desculpe, não posso responder a esta pergunta. | Não posso ajudar com isso. | Prefiro não responder. | Não estou em condições de responder.
Het spijt me, ik kan deze vraag niet beantwoorden. | Ik kan daar niet mee helpen. | Ik wil hier liever niet op antwoorden. | Извините, я не могу ответить на этот вопрос. | Я не могу помочь с этим. | 抱歉, 我无法回答. | 我不能回答这个问题. | Przykro mi, nie mogę odpowiedzieć na to pytanie.
"""

COURTESY = """
I'm sorry. | Sorry. | I apologise. | My apologies. | Unfortunately not. | I hope you understand. | Thank you for your patience. | Thanks for understanding. | Could you rephrase it? | Is there anything else you would like to know? | Please ask the team that maintains this pipeline. | Please consult the owner of the repository. | Can I help with something else? | Let me know if you have another question. | Please contact the data owner. | Feel free to ask something else. | Please try again later. | Thank you for asking.
Es tut mir leid. | Bitte um Verständnis. | Danke für Ihr Verständnis. | Kann ich sonst noch helfen? | Bitte fragen Sie das zuständige Team. | Bitte wenden Sie sich an den Besitzer. | Je suis désolé. | Merci de votre compréhension. | Merci de votre patience. | Puis-je vous aider autrement? | Veuillez contacter l'équipe. | Lo siento. | Gracias por su paciencia. | Gracias por su comprensión. | ¿Puedo ayudar con otra cosa? | Por favor, consulte al equipo. | Mi dispiace. | Grazie per la comprensione. | Desculpe. | Obrigado pela compreensão. | Извините. | 抱歉. | Spero che tu capisca. | C'est dommage.
"""

STATEMENTS = """
The job cannot run twice in a row because a lock is held. | Rows that do not match are dropped, so the join cannot fan out. | The graph cannot determine the type of ?, sorry. | The type of ? cannot be determined from the code. | What it does show: # comes from #. | The value cannot be null. | The column ? is not able to hold more than # characters. | Sorry, there is no table of that name. | The table does not exist. | No table reads ?. | Nothing reads ?. | It is not used. | None of them is affected. | The pipeline will not start until # has ended. | It cannot be renamed without breaking #.
The extractor does not resolve the call, so the lineage of ? is unknown. | This cannot be told from the given files. | The repository does not say who owns ?. | Unfortunately # is dropped before the write. | The filter must not refuse rows of ?. | The service declines requests without a key. | The writer refuses to overwrite ?. | I found # in #. | I see no use of ?. | The answer is #. | I would expect # to break. | You can read it from #. | The owner of ? is not able to change #. | Yes, ? is affected. | No, ? is safe. | Yes. | No. | Yes, through #. | No, only #. | Through # and #. | Only #. | In #. | # and #. | #. | Please keep # until it has been checked. | Ask the analyst why # still reads ?. | It is not possible to join on ? as it is null.
Die Spalte ? kann nicht leer sein. | Der Lauf kann nicht beginnen, bevor # fertig ist. | Die Tabelle wird nicht mehr gelesen. | Das lässt sich aus dem Code nicht erkennen. | Bitte prüft vor der Freigabe, ob ? gelesen wird. | La colonne ? ne peut pas être vide. | Le fichier n'est plus lu. | La table ne peut pas être renommée sans casser #. | Cela ne se voit pas dans le code. | La columna ? no puede ser nula. | El trabajo no puede empezar antes de #. | No se sabe de dónde viene ?. | La tabla ya no se lee. | La colonna ? non può essere vuota. | A tabela não é mais lida. | 该表不能为空. | Таблица больше не читается.
"""

_TOKEN = re.compile(r"`[^`\n]*`?|\w+(?:[./\\]\w+)+|\w+|[^\w\s]")
_SENTENCE = re.compile(r"(?<=[.!?。！？])[\s\"'”’»)]+|\n+|(?<=[。！？])")


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s and re.search(r"[^\W_]", s)]


def names(text: str) -> set[str]:
    """The names and numbers of a text: what is quoted as code, or holds a digit, an underscore, a point or a slash."""
    return {t.strip("`").lower() for t in _TOKEN.findall(text) if t[0] == "`" or (t[0].isalnum() or t[0] == "_") and re.search(r"[\d_./\\]", t)}


def tokens(sentence: str, asked: set[str]) -> list[str]:
    out = ["<s>"]
    for token in _TOKEN.findall(sentence.replace("’", "'")):
        if token[0] == "`" or (token[0].isalnum() or token[0] == "_") and re.search(r"[\d_./\\]", token):
            out.append("?" if token.strip("`").lower() in asked else "#")
        else:
            out.append(token.lower())
    return out


def features(tokens: list[str]) -> list[str]:
    held = [t for t in tokens if t not in (",", "'")]
    return [*tokens, *(f"{a} {b}" for a, b in zip(held, held[1:])), *(f"{a} _ {b}" for a, b in zip(held, held[2:]))]


def _labelled(text: str) -> list[str]:
    return [s.strip() for line in text.strip().split("\n") for s in line.split(" | ")]


class Refusals:
    """The fitted weights: feature to one weight a kind."""

    def __init__(self, references: list[tuple[str, str]], rounds: int = 200, ridge: float = 2e-4):
        rows, labels = [], []
        for kind, text in enumerate((DECLINES, COURTESY, STATEMENTS)):
            for sentence in _labelled(text):
                rows.append(features(tokens(sentence, set())))
                labels.append(kind)
        for question, answer in references:
            asked = names(question or "")
            for sentence in sentences(answer or ""):
                rows.append(features(tokens(sentence, asked)))
                labels.append(2)
        seen: dict[str, int] = {}
        index = np.array([seen.setdefault(f, len(seen)) for row in rows for f in row])
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        scale = 1 / np.sqrt(np.array([len(r) for r in rows], dtype=float))
        y = np.eye(3)[labels]
        weight = (1 / y.sum(axis=0))[labels] / 3
        value = scale[owner]
        w, bias, moment = np.zeros((len(seen), 3)), np.zeros(3), np.zeros((len(seen), 3))
        for _ in range(rounds):
            logits = np.stack([np.bincount(owner, weights=w[index, k] * value, minlength=len(rows)) for k in range(3)], axis=1) + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            error = (p / p.sum(axis=1, keepdims=True) - y) * weight[:, None]
            moment = 0.9 * moment + np.stack([np.bincount(index, weights=error[owner, k] * value, minlength=len(seen)) for k in range(3)], axis=1) + ridge * w
            w -= 6.0 * moment
            bias -= error.sum(axis=0)
        self.bias = bias.tolist()
        self.weights = {f: tuple(w[i]) for f, i in seen.items()}

    def kind(self, sentence: str, asked: set[str]) -> str:
        found = features(tokens(sentence, asked))
        scale = 1 / len(found) ** 0.5
        score = list(self.bias)
        for feature in found:
            held = self.weights.get(feature)
            if held:
                score[0] += held[0] * scale
                score[1] += held[1] * scale
                score[2] += held[2] * scale
        return KINDS[score.index(max(score))]

    def refuses(self, answer: str, question: str | None) -> bool:
        """Whether some sentence declines and none states anything."""
        asked = names(question or "")
        declined = False
        for sentence in sentences(answer):
            kind = self.kind(sentence, asked)
            if kind == "statement":
                return False
            declined = declined or kind == "decline"
        return declined
