from tideline import session


def test_settings_can_be_changed_in_a_running_session(spark):
    assert all(spark.conf.isModifiable(name) for name in session.SETTINGS)


def test_checkpoint_folder_is_the_one_that_is_set(spark):
    folder = session.checkpoint_folder(spark)
    assert folder and session.checkpoint_folder(spark) == folder
