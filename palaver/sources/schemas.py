"""Declared schemas of the raw archive and of the star schema; nothing is inferred."""
from pyspark.sql.types import (
    BinaryType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType,
    TimestampNTZType,
)


def _schema(**columns) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


_int, _long, _str, _bool, _dbl = IntegerType(), LongType(), StringType(), BooleanType(), DoubleType()
_ts, _bin = TimestampNTZType(), BinaryType()

RAW = {
    "handle": _schema(handle_id=_int, id=_str, service=_str),
    "chat": _schema(chat_id=_int, display_name=_str, style=_int),
    "chat_handle": _schema(chat_id=_int, handle_id=_int),
    "message": _schema(
        msg_id=_long, guid=_str, text=_str, body=_bin, handle_id=_int, date=_long, date_read=_long,
        date_delivered=_long, is_from_me=_int, service=_str, associated_message_type=_int,
        associated_message_guid=_str, item_type=_int, cache_has_attachments=_int, is_audio_message=_int,
        thread_originator_guid=_str),
    "chat_message": _schema(chat_id=_int, message_id=_long),
    "attachment": _schema(attachment_id=_long, mime_type=_str, total_bytes=_long),
    "message_attachment": _schema(message_id=_long, attachment_id=_long),
    "contact": _schema(source=_str, record_id=_int, first_name=_str, last_name=_str, organization=_str),
    "contact_phone": _schema(source=_str, record_id=_int, address=_str),
    "contact_email": _schema(source=_str, record_id=_int, address=_str),
    "override_merge": _schema(handle=_str, name=_str),
    "override_rename": _schema(handle=_str, name=_str),
}

# A message whose text is kept once for all messages that say it: the text of ``text_key``, followed by ``text_tail``.
TEXT_KEYS = _schema(text_key=_long, text_tail=_str)

STAR = {
    "persons": _schema(person_id=_int, display_name=_str, source=_str),
    "handles": _schema(handle_id=_int, person_id=_int, raw_id=_str, service=_str),
    "chats": _schema(chat_id=_int, name=_str, is_group=_bool, participant_count=_int),
    "chat_members": _schema(chat_id=_int, person_id=_int),
    "messages": _schema(
        msg_id=_long, guid=_str, chat_id=_int, person_id=_int, is_from_me=_bool, ts_utc=_ts, ts_local=_ts,
        date_delivered=_ts, date_read=_ts, service=_str, text=_str, char_len=_int, word_count=_int,
        emoji_count=_int, has_attachment=_bool, is_audio=_bool, thread_originator_guid=_str,
        session_id=_str, response_seconds=_dbl),
    "tapbacks": _schema(target_guid=_str, person_id=_int, is_from_me=_bool, kind=_str, ts_utc=_ts),
    "attachments": _schema(msg_id=_long, mime_type=_str, total_bytes=_long),
    "emoji_uses": _schema(msg_id=_long, emoji=_str),
    "word_uses": _schema(chat_id=_int, person_id=_int, is_from_me=_bool, year=_str, word=_str, count=_long),
}
