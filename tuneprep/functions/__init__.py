from tuneprep.functions.messages import ChatTemplate, last_assistant, render_chat, role_transcript, to_messages
from tuneprep.functions.text import (
    csv_list,
    none_str,
    prompt_text,
    py_capitalize,
    py_strip,
    qa_text,
    word_tokens,
)

__all__ = [
    "ChatTemplate",
    "csv_list",
    "last_assistant",
    "none_str",
    "prompt_text",
    "py_capitalize",
    "py_strip",
    "qa_text",
    "render_chat",
    "role_transcript",
    "to_messages",
    "word_tokens",
]
