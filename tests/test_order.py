"""Row order of the sorted listings (the oracle comparison ignores it)."""

import pytest

from conftest import SF_SMALL
from quadflow.plans.catalog import queries

Q = queries()
SHOWN = ["published", "ongoing", "draft", "finished", "cancelled"]


def newest(value):
    return -value.timestamp()


# query -> the key its rows must be sorted by
KEYS = {
    "activity_list": lambda x: (SHOWN.index(x.status) + 1, x.start_time, -x.activity_id),
    "activity_list_club": lambda x: (x.viewer_user_id, SHOWN.index(x.status) + 1, x.start_time, -x.activity_id),
    "activity_roster": lambda x: (x.activity_id, -x.reg_id),
    "activity_manage": lambda x: (x.viewer_user_id, -x.activity_id),
    "borrow_orders": lambda x: -x.order_id,
    "borrow_orders_own": lambda x: (x.applicant_user_id, -x.order_id),
    "product_list": lambda x: (newest(x.publish_time), -x.product_id),
    "seller_products": lambda x: (x.seller_user_id, newest(x.publish_time), -x.product_id),
    "order_history": lambda x: (x.user_id, newest(x.create_time), -x.order_id),
    "post_feed": lambda x: (newest(x.create_time), -x.post_id),
    "post_comments": lambda x: (x.post_id, x.create_time, x.comment_id),
    "author_posts": lambda x: (x.author_user_id, newest(x.create_time), -x.post_id),
}


@pytest.mark.parametrize("name", sorted(KEYS))
def test_rows_come_sorted(spark, name):
    keys = [KEYS[name](row) for row in Q[name](spark, SF_SMALL).collect()]
    assert len(set(keys)) > 1
    assert keys == sorted(keys)
