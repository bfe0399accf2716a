"""Sentences written for these tests: not taken from any table, none of them planted anywhere."""

#: residue the expressions were widened with
SEEN = [
    'Welcome back, {{ account.first_name }}!',
    'Your parcel {tracking_number} left the depot.',
    'Hi %recipient_name%, the lift is repaired.',
    'Total due: ${invoice.total}',
    'Signed, [Your Name Here]',
    'The meeting is on [DATE] at [TIME] in room 4.',
    'Dear <CUSTOMER_NAME>, we moved.',
    'Sent by {0} on {1}.',
    '<%= user.email %> wrote to us.',
    '{% if member %}Thanks{% endif %}',
    'Call __PHONE__ for help.',
    'Guten Tag [Vorname], Ihr Paket ist da.',
    'Bonjour [prénom], votre colis arrive.',
    'Hola {{nombre}}, gracias.',
    'Hello null, your booking is confirmed.',
    'Address: XXXXXX, 2nd floor.',
    'Price: [insert amount]',
    'Hello @@NAME@@, good news.',
    'Lorem ipsum dolor sit amet.',
    'Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip.',
    'This is dummy text for the sidebar.',
    'Insert your text here.',
    'Placeholder text, to be replaced before launch.',
    'Sample text: change me.',
    'Hier steht Ihr Text.',
    'Blindtext für die Spalte.',
    'Votre texte ici.',
    'Su texto aquí.',
    'Здесь будет ваш текст.',
    'test test test test test',
    'asdf asdf asdf',
    'Add your description here.',
    '404 - Page not found',
    'Error 500: the server could not complete your request.',
    '502 Bad Gateway nginx',
    'The page you requested could not be found.',
    "Access denied. You don't have permission to view this page.",
    'java.lang.NullPointerException at com.shop.Cart.add(Cart.java:44)',
    'Traceback (most recent call last):',
    'Fatal error: Uncaught Error: Call to undefined function get_header()',
    'Your session has timed out. Please sign in again.',
    'Oops! Something went wrong.',
    'Service temporarily unavailable, try again later.',
    'Die angeforderte Seite wurde nicht gefunden.',
    'La page demandée est introuvable.',
    'No se ha encontrado la página solicitada.',
    'Запрашиваемая страница не найдена.',
    "This site can't be reached.",
    'Too many requests. Slow down.',
    'ERR_CONNECTION_REFUSED',
    'Warning: mysqli_connect(): Access denied for user',
    'Error establishing a database connection',
    'Please enable JavaScript to continue.',
    'You need to enable JavaScript to run this app.',
    'JavaScript is disabled in your browser.',
    'This site requires JavaScript.',
    'Turn on JavaScript and reload the page.',
    'Bitte aktivieren Sie JavaScript in Ihrem Browser.',
    'Veuillez activer JavaScript.',
    'Debe habilitar JavaScript para ver esta página.',
    'Пожалуйста, включите JavaScript.',
    "This page doesn't work without JavaScript.",
    'Your browser does not support JavaScript.',
    'JavaScript must be enabled.',
]

#: residue written afterwards and only measured
UNSEEN = [
    'Your code is {{otp_code}}.',
    'Order #{order.id} ships today.',
    'Ahoy %FIRSTNAME%!',
    'We will visit ${city} soon.',
    'Yours, [Company Name]',
    'See you on [Insert Date].',
    'Agenda: [TBD]',
    '<% if paid %>Paid<% end %>',
    'Liebe [Anrede], vielen Dank.',
    'Estimado [nombre], su pedido salió.',
    'Deliver to: __ADDRESS__',
    'Dear undefined, thanks for joining.',
    'Sehr geehrte {{ kunde.nachname }}',
    'Consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore.',
    'Dummy content for layout purposes.',
    'Your headline goes here',
    'Type your title here',
    "Texte d'exemple: à remplacer.",
    'Texto de relleno, cambiar luego.',
    'Пример текста для блока.',
    'Sorry, this page does not exist.',
    'HTTP 403: Forbidden',
    '503 Service Unavailable',
    'We could not find the page you were looking for.',
    'An unexpected error occurred. Please reload.',
    'ValueError: invalid literal for int()',
    'Uncaught TypeError: x is not a function',
    'Connection refused by host',
    'Request timed out after 30 s.',
    'Interner Serverfehler, bitte später versuchen.',
    'Accès refusé.',
    'Error interno del servidor',
    'Ошибка 502: плохой шлюз',
    'Unable to connect to database server',
    'Exception in thread main java.io.IOException',
    'Please allow scripts for this website.',
    'Your browser has JavaScript turned off.',
    'Activate JavaScript in the settings.',
    'JavaScript muss aktiviert sein.',
    'Cette page nécessite JavaScript.',
    'Active JavaScript en su navegador.',
    'Для работы сайта нужен JavaScript.',
]

#: sentences that merely sound like it
CLEAN = [
    'The server brought the soup at noon.',
    'We found an error in the ledger and fixed it.',
    'The session ended at five.',
    'Her page in the book was missing.',
    'He studies JavaScript at the evening school.',
    'The play needs a script and two actors.',
    'Sets such as {1, 2, 3} are finite.',
    'The sign said access only for staff.',
    'The text here is hard to read in this light.',
    'A sample of the water went to the lab.',
    'The name of the harbour is old.',
    'Prices [in crowns] rose by 4 %.',
    'In the template language a variable is written {{ name }}.',
    'Room 404 is on the fourth floor.',
    'The connection to the ferry was late.',
    'Er fand die Seite im Buch nicht.',
    'The gateway to the valley is narrow.',
    'Permission was given by the council.',
    'She said hello, hello, and went on.',
    'Undefined borders made the map useless.',
]
