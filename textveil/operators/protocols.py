"""The tables of states of the chat and the responses protocol, requests and answers.

Requests are closed: what no rule names is refused if it holds a text.  Answers are open: what
has another shape is passed over.
"""

from __future__ import annotations

from .bodies import Protocol, State, same

_LEAF, _OPEN = {"string": "leaf"}, {"object": "open", "array": "open"}
#: Content parts that hold text.
TEXT_PARTS = ("input_text", "output_text", "text")
#: Top-level fields of a responses request that are passed on unread.
RESPONSES_PASSED = tuple(
    "background client_metadata conversation include include_obfuscation max_output_tokens max_tool_calls metadata model parallel_tool_calls previous_response_id prompt_cache_key "
    "prompt_cache_options prompt_cache_retention reasoning safety_identifier service_tier store stream stream_options temperature text tool_choice tools top_logprobs top_p truncation ttl type user".split()
)
#: Items walked to their texts whatever their shape, and keys that are passed over in them.
FREE_ITEMS = tuple(
    "shell_call shell_call_output local_shell_call local_shell_call_output apply_patch_call apply_patch_call_output mcp_call mcp_approval_request mcp_approval_response program program_output exec".split()
)
FREE_PASSED = tuple(
    "type id call_id status caller namespace name server_label approval_request_id max_output_length role encrypted_content reason phase index output_index content_index sequence_number annotations logprobs".split()
)
#: Items that declare or mark something, and fields of items that identify or route.
PASSED_ITEMS = ("reasoning", "additional_tools", "mcp_list_tools", "item_reference", "compaction_trigger")
ITEM_PASSED = ("type", "role", "id", "call_id", "status", "name", "phase", "namespace", "caller")
#: Top-level fields of a chat request, of its messages and of tool calls that are passed on unread.
CHAT_PASSED = tuple(
    "model tools temperature stream max_tokens max_completion_tokens top_p n stop presence_penalty frequency_penalty logit_bias seed user logprobs top_logprobs "
    "response_format tool_choice parallel_tool_calls stream_options".split()
)
CHAT_TEXTS, CHAT_ROUTING, CALL_ROUTING = ("content", "name", "refusal"), ("role", "tool_call_id"), ("id", "type", "index")

#: States that requests share: any JSON to its strings and numbers, serialised JSON, and fields without a rule.
_SHARED = {
    "json": State({"string": "leaf", "number": "leaf", **_OPEN}, "skip", items="json", rest="json"),
    "arguments": State({"string": "parse", "null": "skip"}),
    "text": State(_LEAF),
    "text or none": State({"string": "leaf", "null": "skip"}),
    "unknown": State({"string": "refuse", **_OPEN}, "skip", items="unknown", rest="unknown"),
}


def _item(field: str, state: str) -> State:
    return State({"object": "open"}, keys={**same(ITEM_PASSED, "skip"), field: state}, rest="unknown")


def responses_request(allow_images: bool = False) -> Protocol:
    """Requests of the responses protocol; ``allow_images`` passes over content parts that hold no text."""
    return Protocol({
        **_SHARED,
        "body": State({"object": "open"}, keys={**same(RESPONSES_PASSED, "skip"), "instructions": "text or none", "input": "input"}, rest="unknown"),
        "input": State({"string": "leaf", "array": "open"}, items="item"),
        "item": State(kinds={
            **same(PASSED_ITEMS, "skip"), **same(FREE_ITEMS, "free"), "message": "message", "function_call": "call", "custom_tool_call": "custom",
            "function_call_output": "output", "custom_tool_call_output": "output",
        }, untyped=("message", ("role", "content"))),
        "message": _item("content", "content"),
        "call": _item("arguments", "arguments"),
        "custom": _item("input", "text or none"),
        "output": _item("output", "content"),
        "free": State({"string": "leaf", **_OPEN}, "skip", items="free", keys=same(FREE_PASSED, "skip"), rest="free"),
        "content": State({"string": "leaf", "null": "skip", "array": "open"}, items="part"),
        "part": State(kinds=same(TEXT_PARTS, "text part"), other="skip" if allow_images else "refuse"),
        "text part": State({"object": "open"}, keys={"type": "skip", "text": "text"}, rest="unknown"),
    })


def responses_answer() -> Protocol:
    """Answers of the responses protocol: texts of message parts, and strings in the arguments of function calls."""
    return Protocol({
        "body": State({"object": "open"}, "skip", keys={"output": "items"}),
        "items": State({"array": "open"}, "skip", items="item"),
        "item": State(otherwise="skip", kinds={"message": "message", "function_call": "call"}, other="skip"),
        "message": State({"object": "open"}, "skip", keys={"content": "content"}),
        "content": State({"array": "open"}, "skip", items="part"),
        "part": State(otherwise="skip", kinds=same(TEXT_PARTS, "text part"), other="skip"),
        "text part": State({"object": "open"}, "skip", keys={"text": "text"}),
        "call": State({"object": "open"}, "skip", keys={"arguments": "arguments"}),
        **_RESTORED,
    }, unparsed="leaf")


#: States of answers: a text, serialised JSON (a text as a whole if it can't be parsed), and JSON to its strings.
_RESTORED = {
    "text": State(_LEAF, "skip"),
    "arguments": State({"string": "parse"}, "skip"),
    "json": State({"string": "leaf", **_OPEN}, "skip", items="json", rest="json"),
}


def chat_request() -> Protocol:
    """Requests of the chat protocol: contents, names and refusals of messages, and the arguments of tool calls."""
    return Protocol({
        **_SHARED,
        "arguments": State({"string": "parse"}),
        "body": State({"object": "open"}, keys={**same(CHAT_PASSED, "skip"), "messages": "messages"}, rest="unknown"),
        "messages": State({"array": "open"}, items="message"),
        "message": State({"object": "open"}, keys={**same(CHAT_TEXTS, "content"), **same(CHAT_ROUTING, "skip"), "tool_calls": "calls"}, rest="unknown"),
        "content": State({"string": "leaf", "null": "skip", "array": "open"}, items="part"),
        "part": State(kinds={"text": "text part"}),
        "text part": State({"object": "open"}, keys={"type": "skip", "text": "content"}, rest="unknown"),
        "calls": State({"array": "open"}, items="a call"),
        "a call": State({"object": "open"}, keys={**same(CALL_ROUTING, "skip"), "function": "function"}, rest="unknown"),
        "function": State({"object": "open"}, keys={"name": "skip", "arguments": "arguments"}, rest="unknown"),
    })


def chat_answer() -> Protocol:
    """Answers of the chat protocol: contents and refusals, and strings in the arguments of tool calls."""
    path = {"body": ("choices", "choices"), "choice": ("message", "message"), "a call": ("function", "function"), "function": ("arguments", "arguments")}
    return Protocol({
        **{s: State({"object": "open"}, "skip", keys={k: to}) for s, (k, to) in path.items()},
        "choices": State({"array": "open"}, "skip", items="choice"),
        "message": State({"object": "open"}, "skip", keys={"content": "content", "refusal": "content", "tool_calls": "calls"}),
        "content": State({"string": "leaf", "array": "open"}, "skip", items="part"),
        "part": State({"object": "open"}, "skip", keys={"text": "text"}),
        "calls": State({"array": "open"}, "skip", items="a call"),
        **_RESTORED,
    }, unparsed="leaf")


def responses_event() -> Protocol:
    """Events of a responses stream: pieces and whole texts, arguments, and the items and responses that repeat them."""
    answer = responses_answer().states
    kinds = {f"response.{x}.{y}": "event of text" for x in ("output_text", "refusal") for y in ("delta", "done")}
    return Protocol({
        **answer,
        "body": State({"object": "open"}, "skip", kinds={
            **kinds, "response.function_call_arguments.delta": "event of call", "response.function_call_arguments.done": "event of call", "response.output_item.done": "event of item",
            **same(("response.completed", "response.incomplete", "response.failed"), "event of answer"),
        }, other="skip"),
        "event of text": State({"object": "open"}, "skip", keys=same(("delta", "text", "refusal"), "text")),
        "event of call": State({"object": "open"}, "skip", keys=same(("delta", "arguments"), "arguments")),
        "event of item": State({"object": "open"}, "skip", keys={"item": "item"}),
        "event of answer": State({"object": "open"}, "skip", keys={"response": "answer"}),
        "answer": answer["body"],
    }, unparsed="leaf")
