"""Conversations for training: alignment of instruction and chat records, templates, choices, tool calls."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

TURN = "struct<role:string,content:string>"


def turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.coalesce(content, F.lit("")).alias("content"))


def no_turns() -> Column:
    return F.array().cast(f"array<{TURN}>")


def joined_query(prompt: Column, query: Column) -> Column:
    """Prompt and query on two lines; empty parts are left out."""
    keep = lambda c: F.when(c != "", c)
    return F.concat_ws("\n", keep(prompt), keep(query))


def align_instruction(prompt: Column, query: Column, response: Column, system: Column, history: Column | None = None) -> dict[str, Column]:
    """Instruction records: history pairs, then the prompt; an answer if there is one."""
    before = F.flatten(F.transform(history, lambda h: F.array(turn("user", h[0]), turn("assistant", h[1])))) if history is not None else no_turns()
    return {
        "_prompt": F.concat(F.coalesce(before, no_turns()), F.array(turn("user", joined_query(prompt, query)))),
        "_response": F.when(response.isNotNull(), F.array(turn("assistant", response))).otherwise(no_turns()),
        "_system": F.coalesce(system, F.lit("")),
    }


def align_chat(messages: Column, role: str = "role", content: str = "content", names: dict[str, str] | None = None) -> dict[str, Column]:
    """Chat records: a leading system turn is lifted; turns must alternate user and assistant sides and end on the latter.

    Broken records keep empty arrays, as upstream keeps them for a later filter.
    """
    names = names or {"user": "user", "assistant": "assistant", "system": "system", "observation": "observation", "function": "function", "human": "user", "gpt": "assistant", "function_call": "function"}
    to = F.create_map(*(x for k, v in names.items() for x in (F.lit(k), F.lit(v))))
    m = F.transform(messages, lambda x: F.struct(to[x[role]].alias("role"), F.coalesce(x[content], F.lit("")).alias("content")))
    lead = F.try_element_at(m, F.lit(1))["role"] == "system"
    rest = F.when(lead, F.slice(m, F.lit(2), F.greatest(F.size(m) - 1, F.lit(0)))).otherwise(m)
    sides = F.transform(rest, lambda x, i: F.when(i % 2 == 0, x["role"].isin("user", "observation")).otherwise(x["role"].isin("assistant", "function")))
    ok = (F.size(rest) > 0) & (F.size(rest) % 2 == 0) & F.forall(sides, lambda x: F.coalesce(x, F.lit(False)))
    none = F.expr(f"cast(array() as array<{TURN}>)")
    return {
        "_prompt": F.when(ok, F.slice(rest, F.lit(1), F.size(rest) - 1)).otherwise(none),
        "_response": F.when(ok, F.slice(rest, -1, 1)).otherwise(none),
        "_system": F.when(lead, F.try_element_at(m, F.lit(1))["content"]).otherwise(F.lit("")),
        "broken": ~ok,
    }


#: Converters by formatting; users add their own with ``register_converter``.
CONVERTERS = {"instruction": align_instruction, "chat": align_chat}


def register_converter(name: str, convert) -> None:
    """Add a converter: a function from columns to the aligned columns by name."""
    if name in CONVERTERS:
        raise ValueError(f"converter {name} already exists")
    CONVERTERS[name] = convert


def preference(response: Column, good: Column) -> Column:
    """A rated response as (chosen, rejected) pair with one empty side."""
    return F.when(good, F.array(response, F.lit(""))).otherwise(F.array(F.lit(""), response))


def valid(prompt: Column, response: Column, answers: int = 1) -> Column:
    """Odd prompt length and enough answers."""
    n = F.size(response)
    return (F.size(prompt) % 2 == 1) & ((n == 1) if answers == 1 else (n >= answers))


@dataclass(frozen=True)
class Template:
    """A chat format: how each role's turn is written; ``{{content}}`` is put in once."""

    user: str = "{{content}}"
    assistant: str = "{{content}}"
    system: str = "{{content}}"
    observation: str = "{{content}}"
    prefix: str = ""
    default_system: str = ""
    stop: tuple[str, ...] = ()
    thought: tuple[str, str] = ("<think>\n", "\n</think>\n\n")
    reasoning: bool = False
    system_in_user: bool = False


#: Users add their own with ``register``.
TEMPLATES: dict[str, Template] = {}


def register(name: str, template: Template) -> Template:
    if name in TEMPLATES:
        raise ValueError(f"template {name} already exists")
    TEMPLATES[name] = template
    return template


_IM = dict(user="<|im_start|>user\n{{content}}<|im_end|>\n<|im_start|>assistant\n", assistant="{{content}}<|im_end|>\n", system="<|im_start|>system\n{{content}}<|im_end|>\n", observation="<|im_start|>tool\n{{content}}<|im_end|>\n<|im_start|>assistant\n", stop=("<|im_end|>",))
register("plain", Template())
register("chatml", Template(**_IM))
register("chatml_think", Template(**_IM, reasoning=True))
register("labelled", Template(user="Human: {{content}}\nAssistant:", assistant="{{content}}\n", system="{{content}}\n", default_system="A chat between a curious user and an assistant."))
register("fused", Template(user="[INST] {{content}} [/INST]", assistant=" {{content}} </s>", system="<<SYS>>\n{{content}}\n<</SYS>>\n\n", system_in_user=True))


# Chat formats of public models, as their model cards give them.
register("alpaca", Template(user="### Instruction:\n{{content}}\n\n### Response:\n", assistant="{{content}}\n\n", system="{{content}}\n\n", default_system="Below is an instruction that describes a task. Write a response that appropriately completes the request."))
register("vicuna", Template(user="USER: {{content}} ASSISTANT:", assistant="{{content}}</s>", system="{{content}} ", default_system="A chat between a curious user and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the user's questions."))
register("llama2", Template(user="<s>[INST] {{content}} [/INST]", assistant=" {{content}} </s>", system="<<SYS>>\n{{content}}\n<</SYS>>\n\n", system_in_user=True))
register("llama3", Template(prefix="<|begin_of_text|>", user="<|start_header_id|>user<|end_header_id|>\n\n{{content}}<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n", assistant="{{content}}<|eot_id|>", system="<|start_header_id|>system<|end_header_id|>\n\n{{content}}<|eot_id|>", observation="<|start_header_id|>ipython<|end_header_id|>\n\n{{content}}<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n", stop=("<|eot_id|>", "<|eom_id|>")))
register("mistral", Template(prefix="<s>", user="[INST] {{content}}[/INST]", assistant=" {{content}}</s>", system="{{content}}\n\n", observation="[TOOL_RESULTS] {\"content\": {{content}}}[/TOOL_RESULTS]", system_in_user=True))
register("gemma", Template(prefix="<bos>", user="<start_of_turn>user\n{{content}}<end_of_turn>\n<start_of_turn>model\n", assistant="{{content}}<end_of_turn>\n", system="{{content}}\n\n", system_in_user=True, stop=("<end_of_turn>",)))
register("phi", Template(user="<|user|>\n{{content}}<|end|>\n<|assistant|>\n", assistant="{{content}}<|end|>\n", system="<|system|>\n{{content}}<|end|>\n", stop=("<|end|>",)))
register("zephyr", Template(user="<|user|>\n{{content}}</s>\n<|assistant|>\n", assistant="{{content}}</s>\n", system="<|system|>\n{{content}}</s>\n"))
register("deepseek", Template(prefix="<｜begin▁of▁sentence｜>", user="User: {{content}}\n\nAssistant:", assistant=" {{content}}<｜end▁of▁sentence｜>", system="{{content}}\n\n"))
register("glm4", Template(prefix="[gMASK]<sop>", user="<|user|>\n{{content}}<|assistant|>", assistant="\n{{content}}", system="<|system|>\n{{content}}", observation="<|observation|>\n{{content}}<|assistant|>", stop=("<|user|>", "<|observation|>")))
register("falcon", Template(user="User: {{content}}\nFalcon:", assistant="{{content}}\n", system="{{content}}\n"))
register("openchat", Template(prefix="<s>", user="GPT4 Correct User: {{content}}<|end_of_turn|>GPT4 Correct Assistant:", assistant="{{content}}<|end_of_turn|>", system="{{content}}", stop=("<|end_of_turn|>",)))


_VICUNA = TEMPLATES["vicuna"]
_LLAMA3, _LLAMA2, _MISTRAL, _GEMMA, _GLM = (TEMPLATES[k] for k in ("llama3", "llama2", "mistral", "gemma", "glm4"))


def family(base: Template, names: dict[str, str | dict]) -> None:
    """Register models that write their turns as another does; a text is the default system, else what differs."""
    for name, other in names.items():
        register(name, replace(base, **({"default_system": other} if isinstance(other, str) else other)))


# Models that share a format, with their default system texts or what differs, as their model cards give them.
_HELPFUL = "You are a helpful assistant."
family(TEMPLATES["chatml"], {
    "qwen": "You are Qwen, created by Alibaba Cloud. You are a helpful assistant.", "qwen2_vl": _HELPFUL, "qwen2_audio": _HELPFUL, "qwen2_omni": _HELPFUL, "qwen3_nothink": "", "llava_next_qwen": _HELPFUL, "minicpm_v": _HELPFUL, "minicpm_o": _HELPFUL,
    "qwen3": {"reasoning": True}, "mimo": {"reasoning": True, "default_system": _HELPFUL}, "keye_vl": {"reasoning": True}, "yi": "", "smollm": "", "smollm2": "You are a helpful AI assistant named SmolLM, trained by Hugging Face.",
    "intern2": {"prefix": "<s>"}, "dbrx": "", "opencoder": "You are OpenCoder, created by OpenCoder Team.", "chatml_de": "Du bist ein freundlicher und hilfsbereiter KI-Assistent.",
})
family(_VICUNA, {"llava": _VICUNA.default_system, "llava_next": _VICUNA.default_system, "llava_next_video": _VICUNA.default_system, "video_llava": _VICUNA.default_system})
family(_LLAMA3, {"mllama": "", "llava_next_llama3": "", "skywork_o1": ""})
family(_LLAMA2, {"llama2_zh": _HELPFUL, "breeze": {"user": "[INST] {{content}} [/INST] ", "assistant": "{{content}}", "system": "{{content}} ", "prefix": "<s>"}})
family(_MISTRAL, {"ministral": "", "pixtral": "", "llava_next_mistral": "", "llava_next_video_mistral": "", "mistral_small": {"system": "[SYSTEM_PROMPT]{{content}}[/SYSTEM_PROMPT]", "system_in_user": False}})
family(_GEMMA, {"gemma2": "", "gemma3": "", "gemma3n": "", "paligemma_chat": ""})
family(_GLM, {"glm4v": {"reasoning": True}, "glm4_moe": {"reasoning": True}, "glmz1": {"reasoning": True}, "glm4v_moe": {"reasoning": True}, "chatglm3": {"prefix": "[gMASK]sop", "user": "<|user|>\n{{content}}<|assistant|>"}})
# Fixed values: (user, assistant, system, prefix) of models with a format of their own.
for _name, (_user, _assistant, _system, _prefix) in {
    "aquila": ("Human: {{content}}###Assistant:", "{{content}}###", "System: {{content}}###", ""), "atom": ("<s>Human: {{content}}\n</s><s>Assistant:", "{{content}}</s>", "{{content}}", ""),
    "baichuan": ("<reserved_102>{{content}}<reserved_103>", "{{content}}", "{{content}}", ""), "baichuan2": ("<reserved_106>{{content}}<reserved_107>", "{{content}}", "{{content}}", ""),
    "belle": ("Human: {{content}}\n\nBelle: ", "{{content}}\n\n", "{{content}}", "<s>"), "bluelm": ("[|Human|]:{{content}}[|AI|]:", "{{content}}</s>", "{{content}}", ""), "codegeex2": ("{{content}}", "{{content}}", "{{content}}", "[gMASK]sop"),
    "cohere": ("<|START_OF_TURN_TOKEN|><|USER_TOKEN|>{{content}}<|END_OF_TURN_TOKEN|><|START_OF_TURN_TOKEN|><|CHATBOT_TOKEN|>", "{{content}}<|END_OF_TURN_TOKEN|>", "<|START_OF_TURN_TOKEN|><|SYSTEM_TOKEN|>{{content}}<|END_OF_TURN_TOKEN|>", "<BOS_TOKEN>"),
    "cpm": ("<用户>{{content}}<AI>", "{{content}}", "{{content}}", "<s>"), "deepseek3": ("<｜User｜>{{content}}<｜Assistant｜>", "{{content}}<｜end▁of▁sentence｜>", "{{content}}", "<｜begin▁of▁sentence｜>"),
    "deepseekcoder": ("### Instruction:\n{{content}}\n### Response:\n", "{{content}}\n<|EOT|>\n", "{{content}}", "<｜begin▁of▁sentence｜>"), "exaone": ("[|user|]{{content}}\n[|assistant|]", "{{content}}[|endofturn|]\n", "[|system|]{{content}}[|endofturn|]\n", ""),
    "granite3": ("<|start_of_role|>user<|end_of_role|>{{content}}<|end_of_text|>\n<|start_of_role|>assistant<|end_of_role|>", "{{content}}<|end_of_text|>\n", "<|start_of_role|>system<|end_of_role|>{{content}}<|end_of_text|>\n", ""),
    "index": ("reserved_0{{content}}reserved_1", "{{content}}", "<unk>{{content}}", ""), "intern": ("<|User|>:{{content}}\n<|Bot|>:", "{{content}}<eoa>\n", "<|System|>:{{content}}\n", "<s>"), "kimi_vl": ("<|im_user|>user<|im_middle|>{{content}}<|im_end|><|im_assistant|>assistant<|im_middle|>", "{{content}}<|im_end|>", "<|im_system|>system<|im_middle|>{{content}}<|im_end|>", ""),
    "llama4": ("<|header_start|>user<|header_end|>\n\n{{content}}<|eot|><|header_start|>assistant<|header_end|>\n\n", "{{content}}<|eot|>", "<|header_start|>system<|header_end|>\n\n{{content}}<|eot|>", "<|begin_of_text|>"), "olmo": ("<|user|>\n{{content}}<|assistant|>\n", "{{content}}<|endoftext|>", "{{content}}", "<|endoftext|>"),
    "orion": ("Human: {{content}}\n\nAssistant: </s>", "{{content}}</s>", "{{content}}", "<s>"), "phi4": ("<|im_start|>user<|im_sep|>{{content}}<|im_end|><|im_start|>assistant<|im_sep|>", "{{content}}<|im_end|>", "<|im_start|>system<|im_sep|>{{content}}<|im_end|>", ""),
    "phi_small": ("<|user|>\n{{content}}<|end|>\n<|assistant|>\n", "{{content}}<|end|>\n", "<|system|>\n{{content}}<|end|>\n", "<|endoftext|>"), "solar": ("### User:\n{{content}}\n\n### Assistant:\n", "{{content}}\n\n", "### System:\n{{content}}\n\n", ""), "starchat": ("<|user|>\n{{content}}<|end|>\n<|assistant|>", "{{content}}<|end|>\n", "<|system|>\n{{content}}<|end|>\n", ""),
    "telechat": ("<_user>{{content}}<_bot>", "{{content}}<_end>", "<_system>{{content}}<_end>", ""), "xuanyuan": ("Human: {{content}} Assistant:", "{{content}}</s>", "{{content}}", ""), "xverse": ("Human: {{content}}\n\nAssistant: ", "{{content}}<|endoftext|>", "{{content}}", ""), "yuan": ("{{content}}<sep>", "{{content}}<eod>\n", "{{content}}", ""), "ziya": ("<human>:{{content}}\n<bot>:", "{{content}}\n", "{{content}}", ""),
}.items():
    register(_name, Template(user=_user, assistant=_assistant, system=_system, prefix=_prefix))
register("deepseekr1", replace(TEMPLATES["deepseek3"], reasoning=True))
register("moonlight", TEMPLATES["kimi_vl"])
register("default", Template(user="Human: {{content}}\nAssistant:", assistant="{{content}}\n", system="System: {{content}}\n"))
register("empty", TEMPLATES["plain"])
register("fewshot", Template(assistant="{{content}}\n\n"))


def slot(pattern: str, content: Column) -> Column:
    """A pattern with its place filled, compiled to a concatenation."""
    before, _, after = pattern.partition("{{content}}")
    return F.concat(F.lit(before), content, F.lit(after)) if _ else F.lit(before)


def with_thought(answer: Column, thinking: bool | None, marks: tuple[str, str] = ("<think>\n", "\n</think>\n\n")) -> Column:
    """An answer of a reasoning model: with thinking off, an empty thought stands before one that has none; else it is left as it is."""
    if thinking is not False:
        return answer
    return F.when(F.contains(answer, F.lit(marks[0].strip())), answer).otherwise(F.concat(F.lit("".join(marks)), answer))


def function_turn(content: Column, write, thought: tuple[str, str] = ("<think>\n", "\n</think>\n\n")) -> Column:
    """A turn of calls given as JSON, written by a dialect (``tools.write_calls``); a thought before the calls stays before their text."""
    pattern = "(?s)^(" + re.escape(thought[0]).replace("\\\n", "\n") + ".*?" + re.escape(thought[1]).replace("\\\n", "\n") + ")"
    lead = F.regexp_extract(content, pattern, 1)
    return F.concat(lead, write(F.substring(content, F.length(lead) + 1, F.length(content))))


def encoded_turns(messages: Column, system: Column, t: Template, thinking: bool | None = None) -> Column:
    """The written form of each turn; the first carries prefix and system text.

    A reasoning template leaves out the thoughts of earlier answers and, with ``thinking`` off, gives the last one an empty thought.
    """
    system = F.when(F.coalesce(system, F.lit("")) == "", F.lit(t.default_system)).otherwise(system)
    head = F.when(system == "", F.lit("")).otherwise(slot(t.system, system))
    last = F.size(messages) - 1

    def write(m: Column, i: Column) -> Column:
        body = m["content"]
        if t.reasoning:  # earlier thoughts are left out
            plain = F.regexp_replace(body, r"(?s)<think>\n.*?\n</think>\n\n", "")
            body = F.when((m["role"] == "assistant") & (i < last), plain).when(m["role"] == "assistant", with_thought(body, thinking, t.thought)).otherwise(body)
        user = slot(t.user, F.concat(F.when(i == 0, head).otherwise(F.lit("")), body)) if t.system_in_user else slot(t.user, body)
        text = F.when(m["role"] == "user", user).when(m["role"] == "observation", slot(t.observation, body)).otherwise(slot(t.assistant, body))
        lead = F.lit(t.prefix) if t.system_in_user else F.concat(F.lit(t.prefix), head)
        return F.when(i == 0, F.concat(lead, text)).otherwise(text)

    return F.transform(messages, write)


def encoded_pairs(messages: Column, system: Column, t: Template) -> Column:
    """(source, target) texts of turns 2i and 2i+1."""
    turns = encoded_turns(messages, system, t)
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(messages) / 2).cast("int") - 1), lambda k: F.struct(F.try_element_at(turns, 2 * k + 1).alias("source"), F.try_element_at(turns, 2 * k + 2).alias("target")))


def choice_question(question: Column, options: list[Column], answer: Column | None, letters: str = "ABCD") -> Column:
    """A multiple-choice question with lettered options, and its answer if given."""
    parts = [question, *(F.concat(F.lit(f"\n{k}. "), o) for k, o in zip(letters, options)), F.lit("\nAnswer:")]
    return F.concat(*parts) if answer is None else F.concat(*parts, F.lit(" "), answer)


def shuffled_options(options: Column, key: Column, seed: int) -> Column:
    """(letter, option) in an order by hash; the gold letter is that of the option that was first."""
    keyed = F.transform(options, lambda o, i: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), i.cast("string"))).alias("h"), i.alias("i"), o.alias("o")))
    order = F.array_sort(keyed)
    return F.transform(order, lambda x, k: F.struct(F.char(k + 65).alias("letter"), x["o"].alias("option"), (x["i"] == 0).alias("gold")))


def placeholder_count(messages: Column, sign: str = "<image>") -> Column:
    """How often a media sign stands in the turns; it must equal the number of media given."""
    return F.aggregate(F.transform(messages, lambda m: F.regexp_count(m["content"], F.lit(re.escape(sign)))), F.lit(0), lambda a, x: a + x)


def image_size(width: Column, height: Column, most: int, least: int) -> Column:
    """(width, height) of an image scaled, sides in proportion, to at most ``most`` and then at least ``least`` pixels; fractions are cut off."""
    scaled = lambda f, x: F.floor(x * f).cast("int")
    down = F.when(width * height > most, F.sqrt(F.lit(float(most)) / (width * height))).otherwise(F.lit(1.0))
    w, h = scaled(down, width), scaled(down, height)
    up = F.when(w * h < least, F.sqrt(F.lit(float(least)) / (w * h))).otherwise(F.lit(1.0))
    return F.struct(scaled(up, w).alias("width"), scaled(up, h).alias("height"))


def frame_places(frames: Column, seconds: Column, fps: float, most: int) -> Column:
    """Evenly spaced frames of a clip: as many as ``fps`` asks for, at most ``most``, at least one."""
    n = F.greatest(F.least(F.floor(seconds * fps), F.lit(most), frames), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(n == 1, F.lit(0)).otherwise(F.floor(i * (frames - 1) / F.greatest(n - 1, F.lit(1)))).cast("int"))


def ollama(t: Template, model: str = ".") -> str:
    """A template as a model file for a local server: its turns, system text and stop signs."""
    put = lambda p, name: p.replace("{{content}}", "{{ ." + name + " }}")
    head = f"{t.prefix}{{{{ if .System }}}}{put(t.system, 'System')}{{{{ end }}}}"
    body = "{{ range .Messages }}" + f'{{{{ if eq .Role "user" }}}}{put(t.user, "Content")}{{{{ else if eq .Role "assistant" }}}}{put(t.assistant, "Content")}{{{{ end }}}}' + "{{ end }}"
    lines = [f"FROM {model}", "", f'TEMPLATE """{head}{body}"""', ""]
    lines += [f'SYSTEM """{t.default_system}"""', ""] if t.default_system else []
    lines += [f'PARAMETER stop "{x}"' for x in t.stop]
    return "\n".join(lines) + "\n"


def jinja(t: Template) -> str:
    """A template as Jinja text."""
    put = lambda p: p.replace("{{content}}", "' + content + '").replace("\n", "\\n")
    lines = [
        "{% if messages[0]['role'] == 'system' %}{% set system = messages[0]['content'] %}{% set loop_messages = messages[1:] %}{% else %}{% set system = '" + t.default_system + "' %}{% set loop_messages = messages %}{% endif %}",
        "{% if system %}{% set content = system %}{{ '" + put(t.prefix + t.system) + "' }}{% endif %}",
        "{% for message in loop_messages %}{% set content = message['content'] %}",
        "{% if message['role'] == 'user' %}{{ '" + put(t.user) + "' }}{% elif message['role'] == 'assistant' %}{{ '" + put(t.assistant) + "' }}{% endif %}",
        "{% endfor %}",
    ]
    return "".join(lines)
