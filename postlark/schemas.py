"""Schemas of the tables that all jobs share, as DDL."""

TABLES = {
    "archives": "archive_id string, path string, name string, kind string, size_bytes long",
    "folders": "archive_id string, folder_id string, parent_id string, name string, path string, depth int, sibling_rank int, container_class string, kind string, content_count long, unread_count long, expunged_count long",
    "raw_messages": "archive_id string, folder_path string, file_path string, seq long, sep_line string, raw binary, size long",
    "headers": "msg_key string, pos int, name string, value string",
    "messages": "msg_key string, archive_id string, folder_path string, seq long, subject string, from_name string, from_email string, to_list string, cc_list string, date timestamp, size long, flags int, message_class string, importance int, message_id string",
    "recipients": "msg_key string, pos int, kind int, name string, email string",
    "parts": "msg_key string, part_path string, depth int, content_type string, params map<string,string>, disposition string, filename string, content_id string, transfer_encoding string, charset string, body binary",
    "bodies": "msg_key string, body_text string, body_html string, body_kind string, body_error string",
    "attachments": "msg_key string, att_no int, filename string, size long, method int, mime_type string, content_id string, is_hidden boolean, payload binary",
    "nodes": "archive_id string, nid long, nid_parent long",
    "properties": "archive_id string, nid long, prop_id int, prop_type int, v_long long, v_double double, v_ts timestamp, v_str string, v_bin binary, v_arr array<string>",
    "name_map": "archive_id string, guid string, lid long, str_name string, prop_id int",
    "contents": "archive_id string, folder_nid long, row_id long, subject string, represented_name string, sender_name string, display_to string, display_cc string, delivery_time timestamp, submit_time timestamp, modified_time timestamp, size long, flags int, message_class string, importance int, failed_cells int",
    "store_folders": "archive_id string, nid long, parent_nid long, name string",
    "store_contents": "archive_id string, folder_nid long, nid long, subject string, represented_name string, sender_name string, sender_email string, display_to string, display_cc string, delivery_time timestamp, submit_time timestamp, modified_time timestamp, size long, flags int, message_class string, importance int, message_id string",
    "store_recipients": "archive_id string, nid long, pos long, kind int, name string, email string, error string",
    "store_attachments": "archive_id string, nid long, att_no int, filename string, size long, method int, mime_type string, content_id string, is_hidden boolean, payload binary, embedded_nid long, error string",
    "store_bodies": "archive_id string, nid long, body_text string, body_html string, body_error string",
    "failures": "archive_id string, location string, msg_key string, reason string",
}
